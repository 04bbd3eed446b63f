"""the search by cells in shared files, packed checkpoints, and oversampling without vectors in the search."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.operators import knn_boxes, oversample
from keelson.operators.knn import _plain_sides, _side_sizes, knn
from keelson.session import checkpoint_dir, cut_lineage, cut_packed

ROWS = "id long, vec array<double>, label long, g string"


def _rows(n, decimals, seed=0):
    x = np.round(np.random.default_rng(seed).normal(size=(n, 5)), decimals)
    x[:, 3] *= 100
    return [(i, v.tolist(), i % 3 if i % 7 else None, "ab"[i % 5 == 0] if i % 50 else None) for i, v in enumerate(x)]


def _found(df):
    return sorted((r["query_id"], r["rank"], r["neighbor_id"], repr(r["neighbor_label"]), repr(round(r["dist"], 9)),
                   repr(r["neighbor_vec"]) if "neighbor_vec" in df.columns else "") for r in df.collect())


@pytest.mark.parametrize("decimals", [0, 1, 6])
@pytest.mark.parametrize("kind", [{}, {"exclude_self": True, "group": "g", "with_vectors": True}])
def test_boxes_find_what_the_plain_search_finds(spark, decimals, kind):
    rows = _rows(900, decimals)
    if decimals == 1:
        rows[5][1][2] = rows[600][1][1] = float("nan")
        rows[80][1][0], rows[81][1][0], rows[82][1][0] = float("inf"), 1e200, None
        rows += rows[100:140]
    t = spark.createDataFrame(rows, ROWS)
    q = t.where("id < 250")
    sides = _plain_sides(q, t, "id", "vec", "id", "vec", "label", kind.get("group"))
    got = knn_boxes.knn_boxes(*sides, _side_sizes(*sides), 6, kind.get("exclude_self", False), "with_vectors" in kind, cell_rows=30)
    assert _found(got) == _found(knn(q, t, 6, "id", "vec", "id", "vec", "label", prune=False, **kind))


def test_large_searches_go_by_cells_and_leave_no_files(spark, monkeypatch):
    calls = []
    real = knn_boxes.knn_boxes
    monkeypatch.setattr(knn_boxes, "knn_boxes", lambda *a, **b: calls.append(1) or real(*a, **b))
    monkeypatch.setattr(knn_boxes, "CELL_ROWS", 16)
    t = spark.createDataFrame(_rows(300, 3), ROWS)
    got = knn(t, t, 4, "id", "vec", "id", "vec", "label", exclude_self=True, prune=True)
    assert calls and _found(got) == _found(knn(t, t, 4, "id", "vec", "id", "vec", "label", exclude_self=True, prune=False))
    held = os.path.join(checkpoint_dir(spark).removeprefix("file:"), "keelson-scratch", "knn")
    assert not os.path.isdir(held) or not os.listdir(held)
    assert knn(t, t.limit(0), 4, "id", "vec", "id", "vec", "label", prune=True).count() == 0


def test_a_query_reads_near_cells_only():
    """Rows on a line in cells of 10: each chunk reads the cells around it, and finds the same."""
    x = np.arange(1000.0)[:, None]
    tree = knn_boxes._Tree(x, 10)
    leaf, pieces = tree.place(x)
    assert len(set(leaf.tolist())) >= 100 and (np.bincount(leaf) <= 10).all() and (pieces == 1).all()
    assert knn_boxes._Tree(np.ones((100, 2)), 10).place(np.ones((5, 2)))[1].tolist() == [5] * 5
    assert tree.place(np.array([[np.nan], [np.inf]]))[0].tolist() == [knn_boxes.ODD] * 2


def test_oversampling_searches_for_the_rows_it_makes(spark, monkeypatch):
    seen = []

    def spied(queries, train, *a, **b):
        seen.append((queries.count(), train.count(), b.get("with_vectors", False)))
        return knn(queries, train, *a, **b)

    monkeypatch.setattr(oversample, "knn", spied)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=3).tolist(), int(i % 5 < 2)) for i in range(100)]
    out = oversample.smote(spark.createDataFrame(rows, "id long, vec array<double>, label long"), "id", "vec", "label", k=3, seed=5)
    assert out.where("synthetic = 1").count() == 20 and out.groupBy("label").count().select("count").distinct().count() == 1
    assert seen == [(20, 40, False)]


def test_packed_checkpoints_are_the_same_rows_in_fewer_bytes(spark):
    df = spark.range(20_000, numPartitions=3).select(
        "id", F.array(*[F.when(F.col("id") % 11 != j, (F.col("id") % (j + 2)).cast("double")) for j in range(20)]).alias("vec"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("x"), F.col("id") % 5)).alias("text"))
    held = checkpoint_dir(spark).removeprefix("file:")
    files = lambda: {os.path.join(d, f) for d, _, fs in os.walk(held) for f in fs if f.startswith("part-")}
    sizes = []
    for cut in (cut_packed, cut_lineage):
        before = files()
        kept = cut(df)
        sizes.append((kept, sum(os.path.getsize(f) for f in files() - before)))
    (packed, few), (plain, many) = sizes
    assert packed.dtypes == df.dtypes and 0 < 2 * few < many
    parts = lambda d: d.withColumn("p", F.spark_partition_id()).collect()
    assert parts(packed) == parts(plain)
