import numpy as np

from keelson.operators.knn_pruned import _Blocks, assign, cells_within, choose_pivots, cut_blocks, first_bounds


def test_small_blocks_are_visited_by_cells(spark):
    """with blocks of 16 rows that no bound can skip, a query is sent to a few cells and not to every block."""
    rng = np.random.default_rng(10)
    x = rng.normal(size=(2_000, 40))
    t = spark.createDataFrame([(i, v.tolist(), 0, "") for i, v in enumerate(x)], "id long, vec array<double>, label long, g string")
    points = choose_pivots(t, 8)
    rows, blocks = cut_blocks(assign(t, spark.sparkContext.broadcast(points)), 16, 40)
    found = blocks.collect()
    cells = {r["cell"] for r in found}
    assert len(found) > 100 and len(cells) <= 8 and rows.count() == 2_000
    assert rows.groupBy("cell").count().count() == len(cells)
    shells = spark.sparkContext.broadcast({"": _Blocks(found, points[""])})
    q = first_bounds(t.where("id < 50").select("id", "vec", "g"), shells, 5)
    out = cells_within(q, shells).collect()
    assert all(len(set(r["cells"])) == len(r["cells"]) < len(cells) for r in out) and max(r["blocks"] for r in out) > 50
