"""Print the formatted physical plan of registered queries.

usage: python tools/explain.py [sf_dir] name [name ...]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from keelson.plans.catalog import QUERIES  # noqa: E402
from keelson.session import get_spark  # noqa: E402


def main():
    args = sys.argv[1:]
    sf = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.1"
    names = [a for a in args if not os.path.isdir(a)]
    spark = get_spark("local[8]", shuffle_partitions=16)
    for n in names:
        print(f"===== {n}")
        QUERIES[n](spark, sf).explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main()
