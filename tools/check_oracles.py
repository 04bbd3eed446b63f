"""Run registered queries in Spark and their SQL oracles in DuckDB; compare
row count, column names and the order-insensitive multiset of rows, exactly.

usage: python tools/check_oracles.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import numpy as np  # noqa: E402
import pandas as pd  # noqa: E402

from keelson.plans.catalog import ORACLES, QUERIES  # noqa: E402
from keelson.session import get_spark  # noqa: E402
from keelson.tables import TABLES  # noqa: E402


def norm(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (np.floating,)):
        v = float(v)
        return None if math.isnan(v) else v
    if isinstance(v, (np.integer,)):
        return int(v)
    if isinstance(v, (np.ndarray, list)):
        return tuple(norm(x) for x in v)
    return v


def rows(pdf):
    cols = sorted(pdf.columns)
    out = [tuple(norm(x) for x in rec) for rec in pdf[cols].itertuples(index=False, name=None)]
    return cols, sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def main():
    args = sys.argv[1:]
    sf = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = [a for a in args if not os.path.isdir(a)] or sorted(QUERIES)
    import json
    extra = json.loads(os.environ.get("KEELSON_EXTRA_CONF", "{}"))   # e.g. '{"spark.sql.ansi.enabled": "false"}'
    spark = get_spark("local[8]", shuffle_partitions=8, extra=extra)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    ok = bad = 0
    for name in names:
        t0 = time.time()
        try:
            sdf = QUERIES[name](spark, sf)
            spdf = sdf.toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in ORACLES:
            print(f"ROWS {name}: {len(spdf)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            opdf = con.sql(ORACLES[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        sc, sr_ = rows(spdf)
        oc, or_ = rows(opdf)
        if sc != oc:
            print(f"FAIL {name}: columns spark={sc} oracle={oc}")
            bad += 1
            continue
        if len(sr_) != len(or_):
            print(f"FAIL {name}: rows spark={len(sr_)} oracle={len(or_)}")
            bad += 1
            continue
        diff = [(a, b) for a, b in zip(sr_, or_) if a != b]
        if diff:
            print(f"FAIL {name}: {len(diff)} rows differ, e.g. spark={diff[0][0]} oracle={diff[0][1]}")
            bad += 1
            continue
        dts = {c: str(spdf[c].dtype) for c in spdf.columns}
        dto = {c: str(opdf[c].dtype) for c in opdf.columns}
        note = "" if dts == dto else f" (dtypes differ: { {c: (dts[c], dto[c]) for c in dts if dts[c] != dto.get(c)} })"
        print(f"OK   {name}: {len(sr_)} rows {ts:.1f}s{note}")
        ok += 1
    print(f"== {ok} ok, {bad} failed")
    spark.stop()


if __name__ == "__main__":
    main()
