"""Above the broadcast bound every lookup falls back to a shuffle join with the same results."""

from pyspark.sql import functions as F

from keelson.operators import joins, ranking
from keelson.plans.catalog import QUERIES
from tests.conftest import SF_SMALL


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_fallback_paths_give_same_results(spark, monkeypatch):
    names = ["label_encode", "freq_encode", "group_stat_encode", "split_stratified", "undersample_balance",
             "conv2d_relational"]
    want = {n: _rows(QUERIES[n](spark, SF_SMALL)) for n in names}
    monkeypatch.setattr(joins, "BROADCAST_MAX_BYTES", 0)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")     # no broadcast by Catalyst's estimate either
    try:
        _check(spark, names, want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _check(spark, names, want):
    for n in names:
        df = QUERIES[n](spark, SF_SMALL)
        plan = df._jdf.queryExecution().executedPlan().toString()
        if n in ("label_encode", "group_stat_encode"):
            assert "BroadcastHashJoin" not in plan, n
        assert _rows(df) == want[n], n


def test_hash_cut_without_broadcast(spark, monkeypatch):
    df = spark.range(500).withColumn("g", (F.col("id") % 2).cast("int"))
    want = {r["id"] for r in ranking.hash_cut(df, "id", 3, lambda n: F.floor(n * F.lit(0.5)), by=["g"]).where("in_cut").collect()}
    monkeypatch.setattr(joins, "BROADCAST_MAX_BYTES", 0)
    got = {r["id"] for r in ranking.hash_cut(df, "id", 3, lambda n: F.floor(n * F.lit(0.5)), by=["g"]).where("in_cut").collect()}
    assert got == want and len(got) == 250
