import os
import tempfile

from pyspark.sql import functions as F

from keelson.operators.linear import linear_score
from keelson.plans import datasets as ds
from keelson.streaming.scoring import run_to_parquet, score_stream
from tests.conftest import SF_SMALL


def test_stream_scores_equal_batch(spark):
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    cols = [F.col("o_totalprice") * F.lit(ds.FEATURE_SCALES[0])]
    top = tempfile.mkdtemp(prefix="keelson-stream-")
    out, checkpoint = os.path.join(top, "out"), os.path.join(top, "checkpoint")
    for _ in range(2):   # the restarted query finds its state: nothing is scored twice
        run_to_parquet(spark, SF_SMALL, orders.schema,
                       lambda s: score_stream(s, cols, [0.5], -0.1, ["o_orderkey"]), out, checkpoint, glob="orders.parquet")
    assert spark.read.parquet(out).count() == orders.count()
    got = {r["o_orderkey"]: r["p"] for r in spark.read.parquet(out).collect()}
    batch = linear_score(orders.select("o_orderkey", F.array(*cols).alias("f")), "f", [0.5], -0.1)
    want = {r["o_orderkey"]: r["p"] for r in batch.collect()}
    assert got == want
