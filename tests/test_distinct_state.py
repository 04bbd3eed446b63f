from pyspark.sql import functions as F

from keelson.operators import distinct, encode


def test_distinct_states_are_whole_numbers_of_a_hash_aggregate(spark):
    """no state of 4 KB per user, no aggregate that sorts objects."""
    df = spark.range(3_000).select("id", (F.col("id") % 900).alias("uid"), (F.col("id") % 200).alias("a"))
    codes = encode.fit_label_codes(df, ["a"])
    state = distinct.distinct_state(df, ["a"], "uid", codes)
    merged = distinct.merge_distinct(state, state)
    assert dict(merged.dtypes)["bits"] == "bigint"
    text = merged._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in text and "SortAggregate" not in text
    got = {r["uid"]: r["uid_a_ct"] for r in distinct.distinct_counts(merged, ["a"], "uid").collect()}
    assert got == {u: len({i % 200 for i in range(u, 3_000, 900)}) for u in range(900)}
    assert merged.agg(F.max("bucket")).first()[0] == 3
