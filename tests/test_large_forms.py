"""Pruned kNN, hot-key joins, merged fits, bitmap counts, sparse features and relational nets against their plain forms."""
import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keelson.operators import clean, distinct, encode, fitted, joins, scale, sparse
from keelson.operators import metrics
from keelson.operators import nets as N
from keelson.operators.knn import _plain_sides, knn
from keelson.operators.knn_pruned import far_apart, knn_pruned
from keelson.plans.q_models import CONV_POOL, net_weights
from keelson.session import scratch_path


def _found(df):
    return sorted((r.query_id, r["rank"], r.neighbor_id, r.neighbor_label, None if math.isnan(r.dist) else round(r.dist, 9)) for r in df.collect())


def _clustered(n, d, centres, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((centres, d)) * 5
    return c[rng.integers(0, centres, n)] + rng.standard_normal((n, d)) * spread


SCHEMA = "id long, vec array<double>, label int, g string"


def test_pruned_knn_skips_over_half_on_clusters(spark):
    x = _clustered(1500, 6, 12, 1)
    t = spark.createDataFrame([(i, v.tolist(), i % 3, "a") for i, v in enumerate(x)], SCHEMA)
    q = spark.createDataFrame([(10_000 + i, v.tolist(), 0, "a") for i, v in enumerate(_clustered(120, 6, 12, 1, 0.1))], SCHEMA)
    got, report = knn_pruned(*_plain_sides(q, t, "id", "vec", "id", "vec", "label", None), 5, block_rows=40, pivots=24)
    assert _found(got) == _found(knn(q, t, 5, "id", "vec", "id", "vec", "label", prune=False))
    assert report["queries"] == 120 and report["visited"] < 0.5 * report["pairs"]


def test_pruned_knn_odd_rows(spark):
    """Ties, repeated vectors, NaN and infinite entries, null labels, queries that are training rows, groups."""
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (300, 2)).astype(float).tolist() + [[0.0, 0.0]] * 200
    x[5], x[6], x[7] = [float("nan"), 1.0], [float("inf"), 0.0], [1e200, -1e200]
    rows = [(i, v, None if i % 7 == 0 else i % 4, "ab"[i % 2]) for i, v in enumerate(x)] + [(900 + i, [float(i), 0.5], 1, "few") for i in range(2)]
    t = spark.createDataFrame(rows, SCHEMA)
    q = spark.createDataFrame(rows[:40] + rows[-2:], SCHEMA)
    for kind in (dict(), dict(exclude_self=True), dict(group="g"), dict(group="g", exclude_self=True)):
        sides = _plain_sides(q, t, "id", "vec", "id", "vec", "label", kind.get("group"))
        got, _ = knn_pruned(*sides, 6, exclude_self=kind.get("exclude_self", False), block_rows=16, pivots=5)
        assert _found(got) == _found(knn(q, t, 6, "id", "vec", "id", "vec", "label", prune=False, **kind))
    none, _ = knn_pruned(*_plain_sides(q, t.limit(0), "id", "vec", "id", "vec", "label", None), 3)
    assert none.collect() == []


def test_far_apart():
    x = np.array([[0.0], [0.1], [10.0], [10.0], [5.0]])
    assert far_apart(x, 3).tolist() == [[0.0], [10.0], [5.0]] and len(far_apart(np.ones((4, 2)), 3)) == 1


def test_hot_key_join_spreads_and_equals_the_plain_join(spark):
    n = 20_000
    left = spark.range(n, numPartitions=8).select(F.col("id").alias("k_id"), F.when(F.col("id") % 20 < 9, F.lit("hot")).when(F.col("id") % 20 == 9, None)
                                                  .otherwise(F.concat(F.lit("k"), F.col("id") % 1500)).alias("key"))
    right = spark.range(1400).select(F.concat(F.lit("k"), F.col("id")).alias("key"), (F.col("id") * 2).alias("v")).unionByName(
        spark.createDataFrame([("hot", -1), ("hot", -2), (None, 5)], "key string, v long"))
    assert joins.heavy_keys(left, "key") == ["hot"]
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for how in ("left", "inner"):
            want = sorted(map(str, left.join(right, "key", how).select("k_id", "key", "v").collect()))
            for bound in (None, 0):  # by a broadcast, and by salting
                got = joins.hot_key_join(left, right, "key", how=how, max_bytes=bound)
                assert sorted(map(str, got.select("k_id", "key", "v").collect())) == want
        out = joins.hot_key_join(left, right, "key", max_bytes=0)
        sizes = sorted(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect())
        assert sizes[-1] < 4 * sizes[len(sizes) // 2] and sizes[-1] < 0.2 * sum(sizes)
        plain = sorted(r["count"] for r in left.join(right, "key", "left").groupBy(F.spark_partition_id()).count().collect())
        assert plain[-1] > 0.4 * sum(plain)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    renamed = joins.hot_key_join(left.limit(50), right.withColumnRenamed("key", "rk"), "key", "rk")
    assert renamed.columns == ["k_id", "key", "rk", "v"]


values = st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6)), max_size=12)


@settings(max_examples=6, deadline=None)
@given(values, values)
def test_merged_moments_equal_one_fit(spark, a, c):
    frame = lambda v: spark.createDataFrame([("u" if i % 2 else "w", x) for i, x in enumerate(v)], "k string, x double")
    whole = frame(a).unionByName(frame(c))
    key = lambda r: tuple(r[c] for c in r.asDict() if c in ("uid", "feature"))
    for fit, keys in ((lambda d: fitted.fit_moments_state(d, ["x"]), ["feature"]), (lambda d: fitted.fit_group_state(d, ["x"], "k"), ["uid", "feature"])):
        got = {key(r): r for r in fitted.merge_moments(fit(frame(a)), fit(frame(c)), keys).collect()}
        want = {key(r): r for r in fit(whole).collect()}
        assert got.keys() == want.keys()
        for k, r in got.items():
            assert r.n == want[k].n and r.least == want[k].least and math.isclose(r["mean"], want[k]["mean"], rel_tol=1e-9, abs_tol=1e-6)
            assert math.isclose(r.m2, want[k].m2, rel_tol=1e-9, abs_tol=1e-2)


def test_states_of_empty_parts_and_counts(spark):
    df = spark.createDataFrame([(1, 2.0, "a"), (2, None, "b"), (3, 6.0, None), (4, 7.0, "a")], "id long, x double, s string")
    empty = df.limit(0)
    state = fitted.merge_moments(fitted.fit_moments_state(df, ["x"]), fitted.fit_moments_state(empty, ["x"]))
    got = [r.x for r in fitted.standardize_from(df, state, ["x"]).orderBy("id").collect()]
    want = [r.x for r in scale.standardize_sample(df, ["x"]).orderBy("id").collect()]
    assert all((g is None) == (w is None) and (g is None or abs(g - w) < 1e-12) for g, w in zip(got, want))
    nothing = fitted.fit_moments_state(empty, ["x"])
    assert {r.x for r in fitted.standardize_from(df, nothing, ["x"]).collect()} == {None}
    assert {r.x for r in fitted.min_shift_from(df, nothing, ["x"]).collect()} == {-1.0}
    counts = fitted.merge_counts(fitted.fit_counts_state(df, ["s", "x"]), fitted.fit_counts_state(empty, ["s", "x"]), fitted.fit_counts_state(df, ["s", "x"]))
    got = sorted(map(str, fitted.freq_from(df, counts, ["s", "x"]).select("id", "s_FE", "x_FE").collect()))
    assert got == sorted(map(str, encode.freq_encode(df, ["s", "x"]).select("id", "s_FE", "x_FE").collect()))


def test_bitmap_distinct(spark):
    rows = [(i, None if i % 11 == 0 else ("hot" if i % 20 < 9 else f"u{i % 7}"), i % 40_000, None if i % 3 == 0 else f"s{i % 5}") for i in range(45_000)]
    df = spark.createDataFrame(rows, "id long, uid string, a long, s string").repartition(6)
    parts = [df.where("id % 2 = 0"), df.where("id % 2 = 1")]
    got = distinct.group_nunique_bitmap(df, ["a", "s"], ["uid"], fit_on=parts)
    want = encode.group_nunique_encode(df, ["a", "s"], ["uid"])
    pick = lambda d: sorted(map(str, d.select("uid", "uid_a_ct", "uid_s_ct").distinct().collect()))
    assert pick(got) == pick(want) and got.count() == df.count()
    state = distinct.distinct_state(df, ["a", "s"], "uid", encode.fit_label_codes(df, ["a", "s"]))
    text = state._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in text
    assert state.where("uid = 'hot'").count() > 2  # spread over buckets


def test_sparse_features_equal_dense_one_hot(spark):
    rows = [(i, None if i % 9 == 0 else f"n{i % 13}", "xyz"[i % 3], float(i % 4), i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, a string, b string, z double, y int")
    train = df.where("id < 60 AND a <> 'n12'")
    layout = sparse.fit_one_hot_sparse(train, ["a", "b"], first=1)
    x = sparse.one_hot_sparse(df, ["a", "b"], layout, dense=["z"])
    cats = {c: encode.one_hot_categories(train, c) for c in ("a", "b")}
    assert layout.size == 1 + sum(map(len, cats.values()))
    dense = {}
    for r in x.collect():
        v = np.zeros(layout.size)
        v[list(r.vec.indices)] = list(r.vec["values"])
        want = [r.z, *[float(r.a == c) for c in cats["a"]], *[float(r.b == c) for c in cats["b"]]]
        assert v.tolist() == want and list(r.vec.indices) == sorted(r.vec.indices)
        dense[r.id] = (np.array(want), r.y)
    w = np.linspace(-1, 1, layout.size)
    weights = spark.createDataFrame([(i, float(v)) for i, v in enumerate(w)], "idx long, w double")
    got = {r.id: r.p for r in sparse.sparse_score(x, "vec", weights, 0.3, ["id"]).collect()}
    p = {i: 1 / (1 + np.exp(-(v @ w + 0.3))) for i, (v, _) in dense.items()}
    assert all(abs(got[i] - p[i]) < 1e-12 for i in p) and len(got) == len(p)
    g = {r.idx: r.g for r in sparse.sparse_gradient(x, "vec", "y", weights, 0.3, "id").collect()}
    want = sum((p[i] - y) * v for i, (v, y) in dense.items()) / len(dense)
    assert all(abs(g.get(i, 0) - v) < 1e-12 for i, v in enumerate(want)) and abs(g[-1] - np.mean([p[i] - y for i, (_, y) in dense.items()])) < 1e-12
    table, bias = sparse.sparse_train_gd(x, "vec", "y", "id", epochs=3, lr=0.5)
    wd, bd = np.zeros(layout.size), 0.0
    mat, ys = np.array([v for v, _ in dense.values()]), np.array([y for _, y in dense.values()])
    for _ in range(3):
        r = 1 / (1 + np.exp(-(mat @ wd + bd))) - ys
        wd, bd = wd - 0.5 * r @ mat / len(ys), bd - 0.5 * r.mean()
    got = {r.idx: r.w for r in table.collect()}
    assert all(abs(got.get(i, 0.0) - v) < 1e-12 for i, v in enumerate(wd)) and abs(bias - bd) < 1e-12


def test_relational_net_needs_one_exchange(spark):
    rng = np.random.default_rng(3)
    im = spark.createDataFrame([(i, rng.standard_normal(64).tolist()) for i in range(30)], "image_id long, pixels array<double>")
    path = scratch_path(spark, "test-relational-images")
    im.write.mode("overwrite").parquet(path)
    im = spark.read.parquet(path)
    weights = net_weights(spark, CONV_POOL)
    out = N.relational_net(im, CONV_POOL, weights)
    rows = {(r.image_id, r.pos): r.value for r in out.collect()}
    for r in N.score_net(im, CONV_POOL, weights).collect():
        assert all(abs(rows[(r.image_id, k)] - v) < 1e-9 for k, v in enumerate(r.logits))
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    moved = [line for line in final.split("\n") if "Exchange" in line and "BroadcastExchange" not in line and "image_id" in line]
    assert len(moved) == 1, final


def test_modes_of_all_kinds_in_one_pass(spark):
    df = spark.createDataFrame([("a", 1, 1.5, True, "2020-01-01"), ("a", 2, None, None, None), ("b", 2, 1.5, False, "2020-01-02"), ("b", None, 2.5, False, "2020-01-02"), (None, 1, 2.5, None, None)],
                               "s string, i int, x double, f boolean, d string").withColumn("d", F.to_date("d"))
    modes = clean.column_modes(df, df.columns)
    assert (modes["s"], modes["i"], modes["x"], modes["f"], str(modes["d"])) == ("a", 1, 1.5, False, "2020-01-02")
    filled = clean.fill_mode(df, df.columns)
    assert filled.dtypes == df.dtypes and filled.where(" OR ".join(f"{c} IS NULL" for c in df.columns)).isEmpty()


def test_place_among_many_cuts(spark):
    cuts = [i / 7 for i in range(1000)]
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.01, 50.0, cuts[640], cuts[999], 1e9)], "x double")
    got = [r.p for r in df.select(metrics._place(cuts, F.col("x")).alias("p")).collect()]
    assert got == [sum(c < x for c in cuts) for x in (-1.0, 0.0, 0.01, 50.0, cuts[640], cuts[999], 1e9)]
