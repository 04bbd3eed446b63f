import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.operators import knn as K
from keelson.operators.oversample import smote


def _frame(spark, X, ids, labels=None):
    rows = [(int(i), [float(v) for v in x], int(l) if labels is not None else 0)
            for i, x, l in zip(ids, X, labels if labels is not None else [0] * len(ids))]
    return spark.createDataFrame(rows, "id long, vec array<double>, label int")


def _brute(Q, qids, T, tids, k):
    out = {}
    for qi, q in zip(qids, Q):
        d = ((T - q) ** 2).sum(1)
        order = sorted(range(len(tids)), key=lambda j: (d[j], tids[j]))[:k]
        out[int(qi)] = [int(tids[j]) for j in order]
    return out


@pytest.mark.parametrize("side", [K.SIDE_BYTES, 2000])
def test_knn_equals_brute_force_with_ties(spark, side):
    rng = np.random.default_rng(1)
    T = rng.normal(size=(120, 6)).round(1)
    T[10] = T[11] = T[12]                     # exact duplicates: ties broken by id
    Q = rng.normal(size=(30, 6)).round(1)
    Q[0] = T[10]
    tids = np.arange(1000, 1120)
    qids = np.arange(30)
    nb = K.knn(_frame(spark, Q, qids), _frame(spark, T, tids), 4, "id", "vec", "id", "vec", "label",
               side_bytes=side)
    got = {}
    for r in nb.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["neighbor_id"])
    assert got == _brute(Q, qids, T, tids, 4)
    assert got[0][:3] == [1010, 1011, 1012]


@pytest.mark.parametrize("side", [K.SIDE_BYTES, 700])
def test_not_a_number_comes_last_and_every_query_gets_its_rows(spark, side):
    rng = np.random.default_rng(4)
    T, Q = rng.normal(size=(20, 3)), rng.normal(size=(4, 3))
    T[7, 1] = T[3, 0] = Q[2, 2] = np.nan
    out = {}
    for r in K.knn(_frame(spark, Q, range(4)), _frame(spark, T, range(20)), 19, "id", "vec", "id", "vec", "label", side_bytes=side) \
            .orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["neighbor_id"], np.isnan(r["dist"])))
    assert all(len(v) == 19 for v in out.values())
    assert [i for i, _ in out[2]] == list(range(19)) and all(n for _, n in out[2])      # a query that is not a number
    for q in (0, 1, 3):
        assert out[q][-1] == (3, True) and not any(n for _, n in out[q][:-1])           # 18 real ones, then the first NaN
        d = ((T - Q[q]) ** 2).sum(1)
        assert [i for i, _ in out[q][:-1]] == sorted([i for i in range(20) if i not in (3, 7)], key=lambda i: (d[i], i))


def test_null_labels_stay_null_and_have_no_vote(spark):
    train = spark.createDataFrame([(0, [0.0], None), (1, [0.1], None), (2, [0.2], 5)], "id long, vec array<double>, label long")
    nb = K.knn(_frame(spark, [[0.0]], [9]), train, 3, "id", "vec", "id", "vec", "label")
    assert [r["neighbor_label"] for r in nb.orderBy("rank").collect()] == [None, None, 5]
    assert [r["pred"] for r in K.majority_vote(nb).collect()] == [5] and [r["mean_label"] for r in K.mean_vote(nb).collect()] == [5.0]


@pytest.mark.parametrize("exclude", [False, True])
def test_all_equal_training_vectors(spark, exclude):
    T = np.ones((3000, 4))
    nb = K.knn(_frame(spark, T[:50], range(50)), _frame(spark, T, range(3000)), 3, "id", "vec", "id", "vec", "label", exclude_self=exclude)
    got = {}
    for r in nb.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["neighbor_id"])
    assert got == {q: [i for i in range(5) if not (exclude and i == q)][:3] for q in range(50)}


def test_empty_sides(spark):
    some, none = _frame(spark, [[1.0, 2.0]], [1]), spark.createDataFrame([], "id long, vec array<double>, label int")
    assert K.knn(some, none, 2, "id", "vec", "id", "vec").collect() == [] and K.knn(none, some, 2, "id", "vec", "id", "vec").collect() == []
    row = K.pairwise_summary(some, none, "id", "vec", "id", "vec").collect()[0]
    assert (row["query_id"], row["nearest_id"], row["mean_dist"], row["n_train"]) == (1, None, None, 0)


def test_pairwise_mean_far_from_the_origin(spark):
    rng = np.random.default_rng(5)
    T, Q = 1e7 + rng.normal(size=(40, 3)), 1e7 + rng.normal(size=(4, 3))
    out = {r["query_id"]: r["mean_dist"] for r in K.pairwise_summary(_frame(spark, Q, range(4)), _frame(spark, T, range(40)), "id", "vec", "id", "vec").collect()}
    assert all(abs(out[i] - ((T - q) ** 2).sum(1).mean()) < 1e-6 for i, q in enumerate(Q))


def test_pairwise_summary(spark):
    rng = np.random.default_rng(2)
    T, Q = rng.normal(size=(50, 3)), rng.normal(size=(5, 3))
    out = {r["query_id"]: r for r in K.pairwise_summary(_frame(spark, Q, range(5)), _frame(spark, T, range(50)),
                                                        "id", "vec", "id", "vec", side_bytes=600).collect()}
    for i, q in enumerate(Q):
        d = ((T - q) ** 2).sum(1)
        assert out[i]["nearest_id"] == int(np.argmin(d))
        assert abs(out[i]["mean_dist"] - d.mean()) < 1e-9 and out[i]["n_train"] == 50


def test_votes(spark):
    nb = spark.createDataFrame([(1, 10, 2, 0.1, 1), (1, 11, 1, 0.2, 2), (1, 12, 1, 0.3, 3), (1, 13, 2, 0.4, 4),
                                (2, 10, 1, 0.1, 1), (2, 11, 2, 0.2, 2)],
                               "query_id long, neighbor_id long, neighbor_label long, dist double, rank int")
    maj = {r["query_id"]: r["pred"] for r in K.majority_vote(nb).collect()}
    assert maj == {1: 1, 2: 1}                   # ties go to the smallest label
    mean = {r["query_id"]: r["pred"] for r in K.mean_vote(nb).collect()}
    assert mean == {1: 2, 2: 2}                   # 1.5 rounds half to even


def test_smote_balances_and_interpolates(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(60, 4))
    y = np.array([1] * 12 + [0] * 48)
    out = smote(_frame(spark, X, range(60), y), "id", "vec", "label", k=3, seed=5)
    counts = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {0: 48, 1: 48}
    syn = [np.array(r["vec"]) for r in out.where(F.col("synthetic") == 1).collect()]
    minority = X[:12]
    for v in syn:                                  # each point lies on a segment between two minority rows
        ok = False
        for i in range(12):
            for j in range(12):
                if i == j:
                    continue
                dvec = minority[j] - minority[i]
                t = np.dot(v - minority[i], dvec) / np.dot(dvec, dvec)
                if -1e-9 <= t <= 1 + 1e-9 and np.allclose(minority[i] + t * dvec, v, atol=1e-9):
                    ok = True
        assert ok


def test_smote_small_classes_and_null_labels(spark):
    rng = np.random.default_rng(6)
    X = rng.normal(size=(40, 3))
    y = [0] * 25 + [1] * 10 + [2] * 3 + [3] + [None]
    rows = [(i, [float(v) for v in x], c) for i, (x, c) in enumerate(zip(X, y))]
    out = smote(spark.createDataFrame(rows, "id long, vec array<double>, label long"), "id", "vec", "label", k=5, seed=2)
    counts = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {0: 25, 1: 25, 2: 25, 3: 25, None: 1}
    new = out.where("synthetic = 1").collect()
    assert sorted(r["id"] for r in new) == list(range(40, 40 + len(new)))       # ids go on without gaps
    assert all(np.allclose(r["vec"], X[38]) for r in new if r["label"] == 3)    # copies of the only member


def test_smote_without_rows(spark):
    assert smote(spark.createDataFrame([], "id long, vec array<double>, label long"), "id", "vec", "label").collect() == []
