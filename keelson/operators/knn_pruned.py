"""Exact kNN that skips block pairs by the triangle inequality (L1 and what rides on it: M4, M5, R4).

1. A bounded number of pivots per group, far from each other, is taken from a bounded sample in hash order.
2. Every training row goes to a near pivot and is cut, by its distance to the pivot, into blocks of about ``block_rows``
   rows: a pivot's blocks are shells with an inner and an outer radius. A shell that is too full (a vector repeated
   without end) is dealt by a hash of the id.
   Neighbouring shells of a pivot make a cell of about CELL_ROWS rows. Blocks are for bounds, cells are what queries visit, so
   a query is sent to no more cells than there are, however small the blocks.
3. First round: from its distances to the pivots, the shells' radii and counts alone, each query gets a bound of its k-th
   distance; searching the cell of its nearest block makes the bound sharper.
4. Second round: a query visits a cell only if the least distance that the triangle inequality allows in one of its blocks
   is within its bound. Queries and cells meet as in :mod:`~keelson.operators.knn`, by the same exact search, which gives
   back what is within the bound, and a window merges.

Rows that are not finite, on either side, take part in all pairs of their group, so the result is that of the plain join:
same order of ties, NaN distances last. Which pivot a row goes to affects the work only. Rounding is covered by a slack.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_uint32
from ..session import cut_lineage, ship_package
from .joins import sized_broadcast

#: Pivots per group, rows sampled for each, and bytes that the pivots of all groups may take.
PIVOTS, SAMPLE, PIVOT_BYTES = 64, 8, 8 << 20
#: Rows of a training block, and blocks that all groups may have together (larger blocks beyond).
BLOCK_ROWS, MOST_BLOCKS = 8192, 1 << 16
#: Rows and bytes of a cell, if a block is not larger.
CELL_ROWS, CELL_BYTES = 16_384, 8 << 20
#: Bins of a pivot's distances from which shells are cut.
BINS = 1024
#: Query rows that meet a block in one task.
CHUNK_ROWS = 16_384
SLACK = 1e-9


def far_apart(vectors: np.ndarray, n: int) -> np.ndarray:
    """Up to n of the vectors, each the farthest from those taken before; equal vectors once."""
    taken, far = [0], ((vectors - vectors[0]) ** 2).sum(axis=1)
    while len(taken) < min(n, len(vectors)) and far.max() > 0:
        taken.append(int(far.argmax()))
        far = np.minimum(far, ((vectors - vectors[taken[-1]]) ** 2).sum(axis=1))
    return vectors[taken]


def choose_pivots(t: DataFrame, pivots: int) -> dict[str, np.ndarray] | None:
    """{group: pivots}; None where the groups are too many for the bound (they are small then)."""
    groups, width = t.agg(F.count_distinct("g"), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
    pivots = min(pivots, PIVOT_BYTES // (8 * max(1, groups) * max(1, width) * SAMPLE))
    if not pivots:
        return None
    finite = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 1e150))
    first = F.row_number().over(Window.partitionBy("g").orderBy(hash_uint32("pivot", "id"), "id"))
    rows = t.where(F.col("g").isNotNull() & finite).withColumn("_n", first).where(F.col("_n") <= pivots * SAMPLE).select("g", "vec").collect()
    by_group: dict[str, list] = {}
    for r in rows:
        by_group.setdefault(r["g"], []).append(r["vec"])
    return {g: far_apart(np.array(v, dtype=np.float64).reshape(len(v), -1), pivots) for g, v in by_group.items()}


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(rows, pivots) distances, by differences; not finite where a row is not."""
    out = np.empty((len(x), len(pivots)))
    for k, p in enumerate(pivots):
        out[:, k] = np.sqrt(((x - p) ** 2).sum(axis=1))
    return out


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _per_group(batch: pa.RecordBatch, at: int):
    coded = batch.column(at).dictionary_encode()
    codes = coded.indices.to_numpy()
    for k, g in enumerate(coded.dictionary.to_pylist()):
        yield g, np.flatnonzero(codes == k)


def assign(t: DataFrame, sent) -> DataFrame:
    """Training rows with their pivot and distance; pivot -1 and distance 0 for rows that are not finite."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, pivot, far = _vectors(b.column(1)), np.full(b.num_rows, -1, np.int32), np.zeros(b.num_rows)
                for g, at in _per_group(b, 3):
                    if g in sent.value:
                        with np.errstate(all="ignore"):
                            d = _distances(x[at], sent.value[g])
                        ok = np.isfinite(d).all(axis=1)
                        best = np.where(ok[:, None], d, 0.0).argmin(axis=1)
                        pivot[at], far[at] = np.where(ok, best, -1), np.where(ok, d[np.arange(len(at)), best], 0.0)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pivot), pa.array(far)], [*b.schema.names, "pivot", "far"])

    return t.mapInArrow(run, "id bigint, vec array<double>, label bigint, g string, pivot int, far double")


def cut_blocks(rows: DataFrame, block_rows: int, width: int) -> tuple[DataFrame, DataFrame]:
    """(rows with ``cell``, blocks: block, cell, g, pivot, inner, outer, n), both numbered in the order of the blocks."""
    n = rows.count()
    block_rows = max(block_rows, -(-n // MOST_BLOCKS))
    widest = sized_broadcast(cut_lineage(rows.groupBy("g", "pivot").agg(F.max("far").alias("widest"))))
    share = F.when(F.col("widest") > 0, F.col("far") / F.col("widest")).otherwise(0.0)
    binned = rows.join(widest, ["g", "pivot"]).withColumn("bin", F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int")).drop("widest")
    bins = binned.groupBy("g", "pivot", "bin").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("g", "pivot").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumns({"shell": F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / block_rows), "salts": F.ceil(F.col("n") / block_rows)})
    bins = sized_broadcast(cut_lineage(bins.drop("n")))
    # a bin that fills blocks by itself is dealt by a hash of the id
    salt = F.when(F.col("salts") > 1, F.pmod(hash_uint32("shell", "id"), F.col("salts"))).otherwise(0)
    placed = binned.join(bins, ["g", "pivot", "bin"]).withColumn("salt", salt).withColumn(
        "shell", F.when(F.col("salts") > 1, -1 - F.col("bin")).otherwise(F.col("shell"))).drop("bin", "salts")
    placed = cut_lineage(placed)
    key = ["g", "pivot", "shell", "salt"]
    blocks = placed.groupBy(*key).agg(F.min("far").alias("inner"), F.max("far").alias("outer"), F.count(F.lit(1)).alias("n"))
    cell_rows = max(block_rows, min(CELL_ROWS, CELL_BYTES // (8 * width + 16)))
    ahead = F.sum("n").over(Window.partitionBy("g", "pivot").orderBy("shell", "salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    blocks = blocks.withColumn("part", F.floor(ahead / cell_rows))
    numbers = {"block": F.row_number().over(Window.orderBy(*key)) - 1, "cell": F.dense_rank().over(Window.orderBy("g", "pivot", "part")) - 1}
    blocks = cut_lineage(blocks.withColumns(numbers).drop("part"))  # MOST_BLOCKS rows or so
    placed = placed.join(sized_broadcast(blocks.select(*key, "cell")), key).select("id", "vec", "label", "g", F.col("cell").cast("bigint").alias("cell"))
    return placed, blocks


class _Blocks:
    """The blocks of one group, for queries."""

    def __init__(self, rows: list, pivots: np.ndarray):
        rows = sorted(rows, key=lambda r: r["block"])
        cell = np.array([r["cell"] for r in rows], np.int64)
        self.begins = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))  # first block of each cell
        self.cells, self.cell = cell[self.begins], cell
        self.pivot = np.array([r["pivot"] for r in rows], np.int64)
        self.inner, self.outer, self.n = (np.array([r[c] for r in rows], np.float64) for c in ("inner", "outer", "n"))
        self.pivots = pivots

    def reach(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, largest) distance that a row of each block can have from each of the queries; blocks of rows that are
        not finite, and queries that are not, have 0 and infinity."""
        with np.errstate(all="ignore"):
            d = _distances(x, self.pivots)[:, np.maximum(self.pivot, 0)] if len(self.pivots) else np.full((len(x), len(self.pivot)), np.inf)
            least = np.maximum(np.maximum(d - self.outer, self.inner - d), 0.0) - SLACK * (d + self.outer)
            most = (d + self.outer) * (1 + SLACK)
        odd = ~np.isfinite(d) | (self.pivot < 0)
        least[odd], most[odd] = 0.0, np.inf
        return least, most


def _slices(b: pa.RecordBatch, blocks: int):
    step = max(1, (4 << 20) // (8 * max(1, blocks)))
    for s in range(0, b.num_rows, step):
        yield b.slice(s, step)


def first_bounds(q: DataFrame, sent, need: int) -> DataFrame:
    """Queries with ``bound`` (the k-th distance is not larger; infinite if unknown) and ``home``, the cell of their nearest
    block."""

    def run(batches):
        for whole in batches:
            for b in _slices(whole, max([len(v.cell) for v in sent.value.values()], default=0)):
                x, bound, home = _vectors(b.column(1)), np.full(b.num_rows, np.inf), np.full(b.num_rows, -1, np.int64)
                for g, at in _per_group(b, 2):
                    held = sent.value.get(g)
                    if held is not None:
                        _, most = held.reach(x[at])
                        nearest = most.argmin(axis=1)
                        found = np.where(held.n[nearest] >= need, most[np.arange(len(at)), nearest], np.inf)
                        few = np.flatnonzero(held.n[nearest] < need)  # more than the nearest block for so many rows
                        order = np.argsort(most[few], axis=1, kind="stable")
                        enough = np.cumsum(held.n[order], axis=1) >= need
                        last = order[np.arange(len(few)), enough.argmax(axis=1)]
                        found[few] = np.where(enough.any(axis=1), most[few, last], np.inf)
                        bound[at], home[at] = found, held.cell[nearest]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bound), pa.array(home, mask=home < 0)], [*b.schema.names, "bound", "home"])

    return q.mapInArrow(run, "id bigint, vec array<double>, g string, bound double, home bigint")


def cells_within(q: DataFrame, sent) -> DataFrame:
    """Queries with ``cells``: those but the home cell that can hold a row within the bound; and the number of blocks that
    they and the home cell are visited for."""

    def run(batches):
        for whole in batches:
            for b in _slices(whole, max([len(v.cell) for v in sent.value.values()], default=0)):
                x, bound = _vectors(b.column(1)), b.column(3).to_numpy(zero_copy_only=False)
                home, lists, blocks = b.column(4).fill_null(-1).to_numpy(), [None] * b.num_rows, np.zeros(b.num_rows, np.int64)
                for g, at in _per_group(b, 2):
                    held = sent.value.get(g)
                    if held is not None:
                        near = held.reach(x[at])[0] <= bound[at][:, None]
                        blocks[at] = near.sum(axis=1)
                        cells = np.logical_or.reduceat(near, held.begins, axis=1) & (held.cells != home[at][:, None])
                        for i, row in zip(at.tolist(), cells):
                            lists[i] = held.cells[row]
                lists = pa.array([v if v is not None else [] for v in lists], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*b.columns[:2], b.column(3), lists, pa.array(blocks)], ["id", "vec", "bound", "cells", "blocks"])

    return q.mapInArrow(run, "id bigint, vec array<double>, bound double, cells array<bigint>, blocks bigint")


def _visit(visits: DataFrame, rows: DataFrame, k: int, exclude_self: bool, with_vectors: bool) -> DataFrame:
    """(id, vec, bound, cell) queries and the training rows of their cells -> neighbours within the bound by query and cell. A
    cell that many queries visit meets them in chunks, each in a task of its own."""
    from .knn import MOST_PARTITIONS, neighbour_schema, searcher

    chunks = cut_lineage(visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS).cast("bigint").alias("chunks")))
    pairs = chunks.agg(F.sum("chunks")).first()[0] or 1
    chunks = sized_broadcast(chunks)
    none = F.lit(None).cast("long").alias("label")
    q = visits.join(chunks, "cell").select(F.lit(True).alias("is_query"), "id", "vec", none, "bound", "cell", F.pmod(hash_uint32("chunk", "id"), F.col("chunks")).alias("chunk"))
    t = rows.join(chunks, "cell").select(F.lit(False).alias("is_query"), "id", "vec", "label", F.lit(None).cast("double").alias("bound"), "cell",
                                         F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"))
    both = q.unionByName(t)
    if pairs > rows.sparkSession.sparkContext.defaultParallelism:  # long work of few bytes
        both = both.repartition(min(MOST_PARTITIONS, 3 * pairs), "cell", "chunk")
    return both.groupBy("cell", "chunk").applyInArrow(searcher(k, exclude_self, with_vectors), neighbour_schema(with_vectors))


def knn_pruned(q: DataFrame, t: DataFrame, k: int, exclude_self: bool = False, with_vectors: bool = False, block_rows: int = BLOCK_ROWS,
               pivots: int = PIVOTS) -> tuple[DataFrame, dict] | None:
    """Neighbours as :func:`~keelson.operators.knn.knn` returns them, of sides (is_query, id, vec, label, g), and a report
    (queries, blocks, pairs of a query and a block of its group, pairs that can hold a neighbour). None where there are too many groups."""
    from .knn import k_best

    spark = t.sparkSession
    ship_package(spark)
    t = cut_lineage(t.select("id", "vec", "label", "g").where(F.col("g").isNotNull()))
    q = cut_lineage(q.select("id", "vec", "g").where(F.col("g").isNotNull()))
    widths = t.select(F.size("vec").alias("d"), F.col("vec").isNull().alias("bad")).unionByName(q.select(F.size("vec").alias("d"), F.col("vec").isNull().alias("bad")))
    least, most, bad = widths.agg(F.min("d"), F.max("d"), F.max("bad")).first()
    if bad or least != most:
        raise ValueError("every vector must be present and have the same length")
    points = choose_pivots(t, pivots)
    if points is None:
        return None
    sent = spark.sparkContext.broadcast(points)
    rows, blocks = cut_blocks(cut_lineage(assign(t, sent)), block_rows, most or 1)
    by_group: dict[str, list] = {}
    for r in blocks.collect():  # MOST_BLOCKS rows or so
        by_group.setdefault(r["g"], []).append(r)
    none = np.zeros((0, most or 0))
    shells = spark.sparkContext.broadcast({g: _Blocks(v, points.get(g, none)) for g, v in by_group.items()})

    start = cut_lineage(first_bounds(q, shells, k + (1 if exclude_self else 0)))
    whole = F.lit(float("inf")).alias("bound")  # so that each query gets all k, for a sharp bound
    near = cut_lineage(_visit(start.where(F.col("home").isNotNull()).select("id", "vec", whole, F.col("home").alias("cell")), rows, k, exclude_self, with_vectors))
    sharp = near.groupBy("query_id").agg(F.when((F.count(F.lit(1)) >= k) & ~F.isnan(F.max("dist")), F.sqrt(F.max("dist")) * (1 + SLACK)).alias("kth"))
    bound = F.least("bound", F.coalesce("kth", F.lit(float("inf"))))
    second = start.join(sharp, start["id"] == sharp["query_id"], "left").select("id", "vec", "g", bound.alias("bound"), "home")
    second = cut_lineage(cells_within(second, shells))
    far = _visit(second.select("id", "vec", "bound", F.explode("cells").alias("cell")), rows, k, exclude_self, with_vectors)
    counts = {g: len(v) for g, v in by_group.items()}
    n, more = second.agg(F.count(F.lit(1)), F.coalesce(F.sum("blocks"), F.lit(0))).first()
    sizes = {r["g"]: r["count"] for r in q.groupBy("g").count().collect()}
    report = {"queries": n, "blocks": sum(counts.values()), "pairs": sum(c * sizes.get(g, 0) for g, c in counts.items()),
              "visited": more}
    return k_best(near.unionByName(far), k), report
