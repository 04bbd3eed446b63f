import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from keelson.functions.hashing import hash_uint32
from keelson.operators import metrics as M
from keelson.operators import ranking, sample


@pytest.mark.parametrize("bits", [1, 4, 20])
def test_hash_rank_equals_row_number(spark, bits):
    df = spark.range(3000).withColumn("g", (F.col("id") % 3).cast("int"))
    got = ranking.hash_rank(df, "id", 9, by=["g"], bits=bits, size_col="n")
    plain = df.withColumn("rank", F.row_number().over(
        Window.partitionBy("g").orderBy(hash_uint32(9, "id"), "id")).cast("bigint"))
    a = {r["id"]: (r["rank"], r["n"]) for r in got.collect()}
    b = {r["id"]: r["rank"] for r in plain.collect()}
    assert {k: v[0] for k, v in a.items()} == b
    assert all(v[1] == 1000 for v in a.values())


def test_split_exact_sizes_disjoint_complete(spark):
    df = spark.range(1001)
    s = sample.split_exact(df, "id", seed=1, test_ratio=0.3)
    counts = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts == {"test": 300, "train": 701}
    assert s.select("id").distinct().count() == 1001
    again = sample.split_exact(df.repartition(5), "id", seed=1, test_ratio=0.3)
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, again.collect()))


def test_stratified_split_per_class(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    s = sample.split_stratified(df, "id", "y", seed=3, test_ratio=0.2)
    got = {(r["y"], r["split"]): r["count"] for r in s.groupBy("y", "split").count().collect()}
    assert got == {(0, "test"): 150, (0, "train"): 600, (1, "test"): 50, (1, "train"): 200}


def test_undersample_balances(spark):
    df = spark.range(500).withColumn("y", (F.col("id") % 5 == 0).cast("int"))
    out = sample.undersample_balance(df, "y", "id", seed=73)
    got = {r["y"]: r["count"] for r in out.groupBy("y").count().collect()}
    assert got == {0: 100, 1: 100}


def test_minibatches_have_the_size_asked_for(spark):
    df = spark.range(1009)
    for epoch in (0, 1):
        sizes = {r["batch_id"]: r["count"] for r in sample.minibatch_ids(df, "id", 64, seed=0, epoch=epoch).groupBy("batch_id").count().collect()}
        assert sizes == {**{i: 64 for i in range(15)}, 15: 1009 - 15 * 64}


def test_split_sizes_by_rounding(spark):
    df = spark.range(1009).withColumn("y", F.when(F.col("id") < 503, 0).when(F.col("id") < 907, 1).otherwise(2))
    size = lambda x: x.where("split = 'test'").count()
    assert size(sample.split_exact(df, "id", 1, 0.2)) == 201 and size(sample.split_exact(df, "id", 1, 0.2, rounding="ceil")) == 202
    out = sample.split_stratified(df, "id", "y", 1, 0.2, rounding="total")
    got = {r["y"]: r["count"] for r in out.where("split = 'test'").groupBy("y").count().collect()}
    # shares of 202: 100.70, 80.88, 20.42; the two largest remainders get one more
    assert got == {0: 101, 1: 81, 2: 20} and out.count() == 1009


def test_first_n(spark):
    out = sample.first_n(spark.range(100), "id", 7, seed=2)
    assert out.count() == 7


def test_confusion_matrix_zero_filled(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (2, 0)], "y int, p int")
    got = {(r["y_true"], r["y_pred"]): r["n"] for r in M.confusion_matrix(df, "y", "p", [0, 1, 2]).collect()}
    assert len(got) == 9 and got[(0, 0)] == 2 and got[(2, 0)] == 1 and got[(1, 1)] == 0


def test_binary_prf_undefined_is_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, p int")
    r = M.binary_prf(df, "y", "p").first()
    assert (r["precision"], r["recall"], r["f1"]) == (0.0, 0.0, 0.0)


def _auc_brute(y, s):
    pos = [a for a, t in zip(s, y) if t == 1]
    neg = [a for a, t in zip(s, y) if t != 1]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_exact_under_ties_and_symmetric(spark):
    rng = np.random.default_rng(0)
    s = np.round(rng.random(400), 2)
    y = (rng.random(400) < s).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    auc = M.roc_auc(df, "y", "s").first()["auc"]
    assert abs(auc - _auc_brute(y, s)) < 1e-12
    flipped = df.withColumn("s", 1.0 - F.col("s"))
    assert abs(auc + M.roc_auc(flipped, "y", "s").first()["auc"] - 1.0) < 1e-12


def test_roc_points_cumulative_all_points(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "y int, s double")
    pts = sorted((r["threshold"], r["fps"], r["tps"]) for r in M.roc_points(df, "y", "s", drop_intermediate=False, include_origin=False).collect())
    assert pts == [(0.1, 2, 2), (0.5, 1, 2), (0.9, 1, 1)]


def test_per_class_accuracy_empty_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "y int, p int")
    got = {r["class"]: (r["correct"], r["total"], r["accuracy"]) for r in M.per_class_accuracy(df, "y", "p", [0, 1, 2]).collect()}
    assert got == {0: (1, 2, 0.5), 1: (1, 1, 1.0), 2: (0, 0, None)}


def test_macro_prf_standard_definitions(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "y int, p int")
    t = {r["class"]: (r["precision"], r["recall"]) for r in M.per_class_prf(df, "y", "p", [0, 1]).collect()}
    assert t == {0: (1.0, 0.5), 1: (2 / 3, 1.0)}


def test_log_loss_clamps(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 1.0), (1, 1.0)], "y int, p double")
    r = M.log_loss(df, "y", "p").first()
    assert abs(r["log_loss"] - 200.0 / 3) < 1e-9


def test_cross_entropy_matches_numpy(spark):
    z = [[1.0, 2.0, 0.5], [0.0, -1.0, 3.0]]
    df = spark.createDataFrame([(z[0], 1), (z[1], 2)], "z array<double>, t int")
    got = M.cross_entropy(df, "z", "t").first()["cross_entropy"]
    zz = np.array(z)
    ref = np.mean(np.log(np.exp(zz).sum(1)) - zz[[0, 1], [1, 2]])
    assert abs(got - ref) < 1e-12


def test_drift_summary(spark):
    df = spark.createDataFrame([("plain", 1, 1), ("plain", 0, 0), ("v", 1, 0), ("v", 0, 0)], "m string, y int, p int")
    got = {r["m"]: (r["accuracy"], r["drift"]) for r in M.model_drift_summary(df, "m", "y", "p", "plain").collect()}
    assert got == {"plain": (1.0, 0.0), "v": (0.5, -0.5)}


def test_null_class_is_kept_by_stratified_split(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i % 2) for i in range(200)], "id long, y int")
    s = sample.split_stratified(df, "id", "y", seed=3, test_ratio=0.2)
    assert s.count() == 200
    got = {(r["y"], r["split"]): r["count"] for r in s.groupBy("y", "split").count().collect()}
    assert got[(None, "test")] == 10 and got[(None, "train")] == 40


def _roc_reference(y, s):
    """The plotting library's roc_curve with drop_intermediate, written out in NumPy."""
    order = np.argsort(-s, kind="mergesort")
    s, y = s[order], y[order]
    idx = np.r_[np.nonzero(np.diff(s))[0], len(s) - 1]
    tps = np.cumsum(y)[idx]
    fps = 1 + idx - tps
    thr = s[idx]
    if len(fps) > 2:
        keep = np.nonzero(np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True])[0]
        fps, tps, thr = fps[keep], tps[keep], thr[keep]
    return list(zip(np.r_[np.inf, thr].tolist(), np.r_[0, fps].tolist(), np.r_[0, tps].tolist()))


def test_roc_points_match_library_convention(spark):
    rng = np.random.default_rng(7)
    s = np.round(rng.random(600), 2)
    y = (rng.random(600) < s).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    want = sorted(_roc_reference(y, s))
    got = sorted((r["threshold"], r["fps"], r["tps"]) for r in M.roc_points(df, "y", "s").collect())
    assert got == want


def test_roc_of_rare_event_scores_spreads_over_the_ranges(spark):
    """All scores below 1e-6: the ranges still share the distinct scores evenly, and the curve is exact."""
    rng = np.random.default_rng(8)
    s = rng.random(20_000) * 1e-6
    y = (rng.random(20_000) < 0.3).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    per = df.select(F.col("s").alias("threshold")).distinct()
    sizes = [r["count"] for r in per.groupBy(M.score_ranges(per, "threshold").alias("b")).count().collect()]
    assert len(sizes) == M.SCORE_RANGES and max(sizes) < 3 * 20_000 / M.SCORE_RANGES
    order = np.argsort(-s)
    ranks = np.empty(20_000)
    ranks[np.argsort(s)] = np.arange(1, 20_001)
    want = (ranks[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (20_000 - y.sum()))
    assert len(order) and abs(M.roc_auc(df, "y", "s").first()["auc"] - want) < 1e-12


def test_roc_leaves_out_null_and_nan_scores(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)]
    odd = [(1, None), (0, None), (1, float("nan")), (0, float("nan")), (1, -3.0), (0, 7.0)]
    clean_, mixed = (spark.createDataFrame(x, "y int, s double") for x in (rows + odd[4:], rows + odd))
    assert sorted(map(str, M.roc_points(clean_, "y", "s").collect())) == sorted(map(str, M.roc_points(mixed, "y", "s").collect()))
    assert M.roc_auc(clean_, "y", "s").first() == M.roc_auc(mixed, "y", "s").first()
    assert M.roc_auc(mixed.where("s IS NULL"), "y", "s").first()["auc"] is None


@pytest.mark.parametrize("bits", [1, 4, 16])
def test_hash_cut_equals_rank_filter(spark, bits):
    df = spark.range(2000).withColumn("g", F.when(F.col("id") % 5 == 0, None).otherwise((F.col("id") % 3).cast("int")))
    cut = ranking.hash_cut(df, "id", 11, lambda n: F.floor(n * F.lit(0.37)), by=["g"], bits=bits)
    got = {r["id"] for r in cut.where("in_cut").collect()}
    ranked = ranking.hash_rank(df, "id", 11, by=["g"], size_col="n")
    want = {r["id"] for r in ranked.where(F.col("rank") <= F.floor(F.col("n") * F.lit(0.37))).collect()}
    assert got == want and cut.count() == 2000
