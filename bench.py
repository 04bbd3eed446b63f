"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print ONE JSON line. Each query is forced to completion with the ``noop``
sink (every row computed, nothing collected to the driver).

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default HEADLINE), BENCH_ALL=1 runs every query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from keelson.plans.catalog import QUERIES  # noqa: E402
from keelson.session import get_spark  # noqa: E402

HEADLINE = [
    "flagship_order_metrics", "group_stat_encode", "freq_encode", "label_encode", "one_hot", "standardize_sample",
    "min_shift", "split_stratified", "undersample_balance", "roc_auc", "roc_points", "confusion_matrix",
    "knn_topk", "knn_majority_vote", "smote_oversample", "lr_train_gd", "dense_square_score", "conv_pool_score",
    "conv2d_relational", "maxpool_relational", "pipeline_fraud", "pipeline_diabetes", "pipeline_passenger",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = os.environ.get("BENCH_QUERIES")
    names = names.split(",") if names else (sorted(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE)
    spark = get_spark(f"local[{cpus}]", app="keelson-bench", shuffle_partitions=max(8, cpus * 2),
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    times = {}
    # warm-up on the smallest tables (JIT, Python workers), same code paths, other data
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    warm = warm if os.path.isdir(warm) else sf_dir
    for w in ("flagship_order_metrics", "scan_images"):
        QUERIES[w](spark, warm).write.format("noop").mode("overwrite").save()
    for name in names:
        t0 = time.time()
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
