"""Exact k-nearest-neighbour join.

Catalyst has no kNN join, and a plain cross join materialises N x M rows. Here both sides are hashed into blocks of
bounded bytes; every query block meets every training block in one task (``applyInArrow`` on the pair of block
numbers), which computes squared distances in NumPy, a tile of bounded bytes at a time against the k-th found so far, and
emits the k best per query; a window merges them by query id.
Nothing passes through the driver but one row of counts, and no pair rows exist. The distance work stays the exact
N x M of the brute-force definition; each side is shipped once per block of the other. Training sides above PRUNE_BYTES go
through :mod:`~keelson.operators.knn_boxes`, which gives the same rows and skips cells that cannot hold a neighbour.

Policy: ties go to the smaller training id; a distance that is not a number (or overflows) is reported as NaN and comes
after all others, by id, so every query gets min(k, m) rows; a null training label stays null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_uint32
from ..session import cut_lineage, ship_package

#: Bytes of vectors in a training or query block.
SIDE_BYTES = 8 * 1024 * 1024
#: Query rows and training rows of a tile of distances inside a task, the rows that its first bounds come from, and the
#: close pairs that are held before the bounds are drawn in.
TILE_ROWS, TILE_COLUMNS, SEED_COLUMNS, HELD_PAIRS = 512, 1024, 256, 1 << 18
#: Bytes of distances where the rows are not all finite.
ODD_BYTES = 16 * 1024 * 1024
#: Distance work (query rows x training rows x dims) that one pair of blocks aims at, and partitions of pairs at most.
WORK_PER_TASK, MOST_PARTITIONS = 2e10, 2048
#: Vectors with larger squares are compared apart: the square of a difference could overflow.
LARGEST_SQUARE = 1e290

#: Bytes of training vectors from which the search goes by cells (the result is the same).
PRUNE_BYTES = 64 * 1024 * 1024

NEIGHBOUR_SCHEMA = "query_id long, neighbor_id long, neighbor_label long, dist double"
SUMMARY_SCHEMA = "query_id long, nearest_id long, min_dist double, sum_dist double, n_train long"


def _matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """Rows of an Arrow list column as a float64 matrix; all rows must have the same length."""
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)  # a null element becomes NaN
    width = len(flat) // rows if rows else 0
    lengths = np.diff(column.offsets.to_numpy())
    if column.null_count or (lengths != width).any() or (dim is not None and rows and width != dim):
        raise ValueError("every vector must be present and have the same length")
    return flat.reshape(rows, width)


class _Train:
    """A training block: distinct vectors, each with its ids in ascending order. ``per`` ids of each are kept, so a
    vector that is repeated without end costs no more than one that is repeated ``per`` times."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, per: int):
        order = np.argsort(ids, kind="stable")
        rows = np.ascontiguousarray(vectors[order])
        bits = rows.view(np.dtype((np.void, 8 * rows.shape[1]))).reshape(-1) if rows.shape[1] else np.zeros(len(rows), np.uint8)
        _, first, place = np.unique(bits, return_index=True, return_inverse=True)
        by_id = np.argsort(first, kind="stable")  # distinct vectors in the order of their least id
        rank = np.empty(len(by_id), np.int64)
        rank[by_id] = np.arange(len(by_id))
        group = rank[place]
        grouped = np.argsort(group, kind="stable")
        sizes = np.bincount(group, minlength=len(by_id))
        begins = np.cumsum(sizes) - sizes
        within = np.arange(len(group)) - np.repeat(begins, sizes)
        self._measure(rows[first[by_id]], order[grouped[within < per]], np.minimum(sizes, per))

    @classmethod
    def of(cls, vectors: np.ndarray, members: np.ndarray, kept: np.ndarray) -> _Train:
        """A block whose distinct vectors, rows by vector and id, and rows of each vector are known."""
        block = cls.__new__(cls)
        block._measure(vectors, members, kept)
        return block

    def _measure(self, vectors: np.ndarray, members: np.ndarray, kept: np.ndarray) -> None:
        self.vectors = vectors
        self.members = members  # row numbers of the block, by distinct vector and id
        self.kept = kept
        self.begins = np.cumsum(self.kept) - self.kept
        self.squares = np.einsum("ij,ij->i", self.vectors, self.vectors)
        # rows whose distances cannot overflow: around their mean, with their squares as a last column, so that one matrix
        # product gives distances but for the query's own square
        self.fine = np.flatnonzero(self.squares < LARGEST_SQUARE)
        plain = self.vectors if len(self.fine) == len(self.vectors) else self.vectors[self.fine]
        self.centre = plain.mean(axis=0) if len(plain) else np.zeros(vectors.shape[1])
        self.wide = np.empty((len(plain), vectors.shape[1] + 1))
        np.subtract(plain, self.centre, out=self.wide[:, :-1])
        self.wide[:, -1] = np.einsum("ij,ij->i", self.wide[:, :-1], self.wide[:, :-1])


def _tolerance(width: int, q_sq: np.ndarray, largest: float) -> np.ndarray:
    """Bound of the rounding error of expanded distances."""
    return 16.0 * (width + 2) * np.finfo(np.float64).eps * (q_sq + largest) + 1e-300


def _drawn_in(rows: np.ndarray, cols: np.ndarray, e: np.ndarray, kth: np.ndarray, tol: np.ndarray, k: int):
    """The close pairs without those that k others of their row rule out; lowers ``kth``, the k-th value of each row."""
    order = np.lexsort((e, rows))
    rows, cols, e = rows[order], cols[order], e[order]
    begins = np.searchsorted(rows, np.arange(len(kth)))
    full = np.diff(np.append(begins, len(rows))) >= k
    kth[full] = np.minimum(kth[full], e[begins[full] + k - 1])
    keep = e <= (kth + tol)[rows]
    return rows[keep], cols[keep], e[keep]


def _close_pairs(q: np.ndarray, train: _Train, k: int, bound: np.ndarray | None):
    """(rows, fine distinct vectors) among which are the k nearest of each query row or, with ``bound`` (squared), those of
    them within it; and the k-th distances."""
    width, m = q.shape[1], len(train.wide)
    a = np.empty((len(q), width + 1))
    np.subtract(q, train.centre, out=a[:, :-1])
    q_sq = np.einsum("ij,ij->i", a[:, :-1], a[:, :-1])
    a[:, :-1] *= -2.0
    a[:, -1] = 1.0
    tol = _tolerance(width, q_sq, train.wide[:, -1].max())
    first = min(m, max(SEED_COLUMNS, 4 * k))
    kth = np.partition(a @ train.wide[:first].T, k - 1, axis=1)[:, k - 1]
    if bound is not None:
        kth = np.minimum(kth, bound - q_sq)
    held, parts, n, e = None, [], 0, np.empty((len(q), min(m, TILE_COLUMNS)))
    for s in range(0, m, TILE_COLUMNS):
        tile = train.wide[s:s + TILE_COLUMNS]
        d = e if len(tile) == e.shape[1] else np.empty((len(q), len(tile)))
        np.matmul(a, tile.T, out=d)
        at = np.flatnonzero(d <= (kth + tol)[:, None])
        parts.append((at // len(tile), at % len(tile) + s, d.reshape(-1)[at]))
        n += len(at)
        if n > HELD_PAIRS or s == 0 or s + TILE_COLUMNS >= m:
            held = _drawn_in(*(np.concatenate(c) for c in zip(*([held] if held else []), *parts)), kth, tol, k)
            parts, n = [], 0
    return held[0], held[1], kth + q_sq


def _odd_candidates(q: np.ndarray, train: _Train, k: int):
    """As :func:`_candidates`, for rows that are not finite or whose distances may overflow. Where fewer than k are finite,
    the first of the rest by id are added."""
    q_sq = (q * q).sum(axis=1)
    d = q_sq[:, None] + train.squares[None, :] - 2.0 * (q @ train.vectors.T)
    for i in np.flatnonzero(~np.isfinite(q_sq) & np.isfinite(q).all(axis=1)):  # the square overflows, a distance need not
        d[i] = ((q[i] - train.vectors) ** 2).sum(axis=1)
    d[~np.isfinite(d)] = np.inf
    k = min(k, d.shape[1])
    kth = np.partition(d, k - 1, axis=1)[:, k - 1]
    largest = train.squares[np.isfinite(train.squares)].max(initial=0.0)
    tol = _tolerance(q.shape[1], np.where(np.isfinite(q_sq), q_sq, 0.0), largest)
    near = (d <= (kth + tol)[:, None]) & np.isfinite(d)
    short = np.flatnonzero(~np.isfinite(kth))
    if len(short):
        odd = ~np.isfinite(d[short])
        near[short] |= odd & (np.cumsum(odd, axis=1) <= k)
    return np.nonzero(near)


def _candidates(q: np.ndarray, train: _Train, k: int, bound: np.ndarray | None = None):
    """(rows, distinct vectors) that hold the k nearest of each query row, or those of them within its ``bound`` (squared):
    expanded distances by matrix products, cut with a bound of their rounding error."""
    fine = np.zeros(len(q), bool)
    if len(train.fine) >= k:
        with np.errstate(all="ignore"):
            fine = np.einsum("ij,ij->i", q, q) < LARGEST_SQUARE
    found, some = [], np.flatnonzero(fine)
    for s in range(0, len(some), TILE_ROWS):
        at = some[s:s + TILE_ROWS]
        rows, which, kth = _close_pairs(q[at], train, k, None if bound is None else bound[at])
        # with the k-th so far off, vectors left out as too large could be as near
        sure = kth < 0.1 * LARGEST_SQUARE if len(train.fine) < len(train.vectors) else np.ones(len(at), bool)
        fine[at[~sure]] = False
        keep = sure[rows]
        found.append((at[rows[keep]], train.fine[which[keep]]))
    odd, step = np.flatnonzero(~fine), max(1, ODD_BYTES // (8 * max(1, len(train.vectors))))
    for s in range(0, len(odd), step):
        with np.errstate(all="ignore"):
            rows, which = _odd_candidates(q[odd[s:s + step]], train, k)
        found.append((odd[s:s + step][rows], which))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _nearest(q: np.ndarray, ids: np.ndarray, train: _Train, k: int, self_ids: np.ndarray | None, bound: np.ndarray | None = None):
    """(query rows, training rows, distances) of the k nearest of each query row, exact; with ``bound`` (squared), those
    beyond it may be missing."""
    extra = 1 if self_ids is not None else 0
    rows, which = _candidates(q, train, k + extra, bound)
    diff = q[rows] - train.vectors[which]
    dist = np.einsum("ij,ij->i", diff, diff)
    dist[~np.isfinite(dist)] = np.nan
    n = train.kept[which]
    ends = np.cumsum(n)
    members = train.members[np.repeat(train.begins[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
    rows, dist = np.repeat(rows, n), np.repeat(dist, n)
    if self_ids is not None:
        other = ids[members] != self_ids[rows]
        rows, dist, members = rows[other], dist[other], members[other]
    order = np.lexsort((ids[members], dist, rows))  # NaN sorts last
    rows, dist, members = rows[order], dist[order], members[order]
    begins = np.searchsorted(rows, rows, "left")
    keep = np.arange(len(rows)) - begins < k
    return rows[keep], members[keep], dist[keep]


def _plain_sides(queries: DataFrame, train: DataFrame, query_id: str, query_vec: str, train_id: str, train_vec: str,
                 train_label: str | None, group: str | None) -> tuple[DataFrame, DataFrame]:
    """Both sides as (is_query, id, vec, label, g)."""
    double = lambda c: F.transform(c, lambda x: x.cast("double"))
    g = F.col(group).cast("string") if group else F.lit("")
    q = queries.select(F.lit(True).alias("is_query"), F.col(query_id).cast("long").alias("id"), double(query_vec).alias("vec"),
                       F.lit(None).cast("long").alias("label"), g.alias("g"))
    t = train.select(F.lit(False).alias("is_query"), F.col(train_id).cast("long").alias("id"), double(train_vec).alias("vec"),
                     (F.col(train_label).cast("long") if train_label else F.lit(None).cast("long")).alias("label"), g.alias("g"))
    return q, t


def _side_sizes(q: DataFrame, t: DataFrame) -> DataFrame:
    """(g, n_q, n_t, d) of the groups."""
    sizes = q.select("g", F.lit(1).alias("q"), F.lit(0).alias("t"), F.size("vec").alias("d")).unionByName(
        t.select("g", F.lit(0).alias("q"), F.lit(1).alias("t"), F.size("vec").alias("d")))
    return sizes.groupBy("g").agg(F.sum("q").alias("n_q"), F.sum("t").alias("n_t"), F.greatest(F.max("d"), F.lit(1)).alias("d"))


def _paired(q: DataFrame, t: DataFrame, sizes: DataFrame, side_bytes: int, grouped: bool) -> DataFrame:
    """Rows of both sides dealt to all pairs of a query block and a training block of the same group. Numbers of blocks
    follow the group's ``sizes``."""
    spark = q.sparkSession
    width = F.col("d") * 8 + 16
    t_blocks = F.greatest(F.ceil(F.col("n_t") * width / side_bytes), F.lit(1))
    spread = F.ceil(F.lit(spark.sparkContext.defaultParallelism) / F.col("t_blocks")) if not grouped else F.lit(1)
    work = F.ceil(F.col("n_q") * F.col("n_t") * F.col("d") / WORK_PER_TASK / F.col("t_blocks"))
    q_blocks = F.least(F.col("n_q"), F.greatest(spread, work, F.ceil(F.col("n_q") * width / side_bytes)))
    blocks = sizes.withColumn("t_blocks", t_blocks).withColumn("q_blocks", F.greatest(q_blocks, F.lit(1)))
    blocks = blocks.select("g", F.col("t_blocks").cast("int").alias("t_blocks"), F.col("q_blocks").cast("int").alias("q_blocks"))
    if not grouped:  # one row of numbers
        row = blocks.first()
        counts = [F.lit(row[c] if row else 1).alias(c) for c in ("t_blocks", "q_blocks")]
        q, t = q.select("*", *counts), t.select("*", *counts)
        pairs = row["t_blocks"] * row["q_blocks"] if row else 1
    else:  # one row per group, kept apart from the sides' plans
        blocks = cut_lineage(blocks)
        q, t = q.join(blocks, "g"), t.join(blocks, "g")
        pairs = blocks.agg(F.sum(F.col("t_blocks").cast("bigint") * F.col("q_blocks"))).first()[0] or 1
    own = lambda tag, n: F.pmod(hash_uint32(tag, "id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = q.withColumn("qb", own("query", "q_blocks")).withColumn("tb", every("t_blocks"))
    t = t.withColumn("tb", own("train", "t_blocks")).withColumn("qb", every("q_blocks"))
    both = q.unionByName(t).drop("t_blocks", "q_blocks")
    # pairs of blocks are long work of few bytes, which must not be joined into few partitions by their bytes
    return both.repartition(min(MOST_PARTITIONS, 3 * pairs), "g", "qb", "tb") if pairs > spark.sparkContext.defaultParallelism else both


def _sides(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    is_query = table.column("is_query")
    return table.filter(is_query).combine_chunks(), table.filter(pc.invert(is_query)).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    c = table.column(name)
    return c.chunk(0) if c.num_chunks else pa.array([], c.type)


def neighbour_schema(with_vectors: bool) -> str:
    return NEIGHBOUR_SCHEMA + (", neighbor_vec array<double>" if with_vectors else "")


def searcher(k: int, exclude_self: bool, with_vectors: bool):
    """The function of one group that holds a block of each side: the k nearest of each query row in it or, where the rows
    have a ``bound``, those of them within it."""
    fields = [("query_id", pa.int64()), ("neighbor_id", pa.int64()), ("neighbor_label", pa.int64()), ("dist", pa.float64())]
    schema = pa.schema([*fields, *([("neighbor_vec", pa.list_(pa.float64()))] if with_vectors else [])])

    def run(table: pa.Table) -> pa.Table:
        q, t = _sides(table)
        out = []
        if q.num_rows and t.num_rows:
            ids = _column(t, "id").to_numpy()
            vectors = _matrix(_column(t, "vec"))
            held = _Train(ids, vectors, k + (1 if exclude_self else 0))
            q_ids, q_vec = _column(q, "id").to_numpy(), _matrix(_column(q, "vec"), vectors.shape[1])
            far = _column(q, "bound").to_numpy() if "bound" in q.column_names else None
            step = 4 * TILE_ROWS
            for s in range(0, len(q_ids), step):
                bound = None if far is None else far[s:s + step] * far[s:s + step] * (1 + 1e-9)
                rows, members, dist = _nearest(q_vec[s:s + step], ids, held, k, q_ids[s:s + step] if exclude_self else None, bound)
                picked = pa.array(members)
                cols = {"query_id": q_ids[s:s + step][rows], "neighbor_id": ids[members], "neighbor_label": _column(t, "label").take(picked), "dist": dist}
                if with_vectors:
                    cols["neighbor_vec"] = _column(t, "vec").take(picked)
                out.append(pa.table(cols))
        return pa.concat_tables([x.cast(schema) for x in out]) if out else schema.empty_table()

    return run


def k_best(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy("dist", "neighbor_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= F.lit(k))


def knn(queries: DataFrame, train: DataFrame, k: int, query_id: str, query_vec: str, train_id: str,
        train_vec: str, train_label: str | None = None, exclude_self: bool = False,
        side_bytes: int = SIDE_BYTES, group: str | None = None, with_vectors: bool = False, prune: bool | None = None) -> DataFrame:
    """L1: the k nearest training rows of every query row by squared Euclidean distance, ordered by (dist, neighbor_id):
    columns query_id, neighbor_id, neighbor_label, dist, rank (1-based), and neighbor_vec if ``with_vectors``. With
    ``group``, a column of both sides, neighbours come from the query's own group (rows without a group have none).
    ``prune`` forces or forbids the pruned search, which otherwise depends on the training side's size."""
    ship_package(queries.sparkSession)
    q, t = _plain_sides(queries, train, query_id, query_vec, train_id, train_vec, train_label, group)
    sizes = cut_lineage(_side_sizes(q, t))
    held = sizes.agg(F.sum(F.col("n_t") * (F.col("d") * 8 + 16))).first()[0] or 0
    if prune or (prune is None and held > PRUNE_BYTES):
        from .knn_boxes import knn_boxes

        pruned = knn_boxes(q, t, sizes, k, exclude_self, with_vectors)
        if pruned is not None:
            return pruned
    found = _paired(q, t, sizes, side_bytes, group is not None).groupBy("g", "qb", "tb").applyInArrow(
        searcher(k, exclude_self, with_vectors), neighbour_schema(with_vectors))
    return k_best(found, k)


def pairwise_summary(queries: DataFrame, train: DataFrame, query_id: str, query_vec: str, train_id: str,
                     train_vec: str, side_bytes: int = SIDE_BYTES) -> DataFrame:
    """J4 + D1 over all (query, train) pairs without emitting them: per query the
    nearest training id, its distance, and the mean distance to the whole train set."""
    ship_package(queries.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        q, t = _sides(table)
        q_ids, m = _column(q, "id").to_numpy(), t.num_rows
        nearest, least, total = np.zeros(len(q_ids), np.int64), np.full(len(q_ids), np.nan), np.zeros(len(q_ids))
        if m and len(q_ids):
            ids, vectors = _column(t, "id").to_numpy(), _matrix(_column(t, "vec"))
            q_vec, held = _matrix(_column(q, "vec"), vectors.shape[1]), _Train(ids, vectors, 1)
            step = 4 * TILE_ROWS
            # sum over all pairs in closed form, around the block's mean: m |q - c|^2 + sum |t - c|^2
            centre = vectors.mean(axis=0)
            around = ((vectors - centre) ** 2).sum()
            for s in range(0, len(q_ids), step):
                part = q_vec[s:s + step]
                rows, members, dist = _nearest(part, ids, held, 1, None)
                nearest[s + rows], least[s + rows] = ids[members], dist
                total[s:s + step] = m * ((part - centre) ** 2).sum(axis=1) + around
        return pa.table({"query_id": pa.array(q_ids, pa.int64()), "nearest_id": pa.array(nearest, mask=np.full(len(q_ids), not m)),
                         "min_dist": pa.array(least, mask=np.full(len(q_ids), not m)), "sum_dist": total,
                         "n_train": np.full(len(q_ids), m, np.int64)})

    q, t = _plain_sides(queries, train, query_id, query_vec, train_id, train_vec, None, None)
    out = _paired(q, t, _side_sizes(q, t), side_bytes, False).groupBy("g", "qb", "tb").applyInArrow(run, SUMMARY_SCHEMA)
    best = F.min(F.when(F.col("nearest_id").isNotNull(), F.struct(F.col("min_dist"), F.col("nearest_id"))))
    agg = out.groupBy("query_id").agg(best.alias("_b"), F.sum("sum_dist").alias("sum_dist"), F.sum("n_train").alias("n_train"))
    return agg.select("query_id", F.col("_b.nearest_id").alias("nearest_id"), F.col("_b.min_dist").alias("min_dist"),
                      F.when(F.col("n_train") > 0, F.col("sum_dist") / F.col("n_train")).alias("mean_dist"), F.col("n_train").cast("bigint"))


def majority_vote(neighbours: DataFrame, out: str = "pred") -> DataFrame:
    """M4: most frequent neighbour label per query, the smallest label on ties; a null label has no vote."""
    counts = neighbours.where(F.col("neighbor_label").isNotNull()).groupBy("query_id", "neighbor_label").agg(F.count(F.lit(1)).alias("_n"))
    best = F.max(F.struct(F.col("_n"), (-F.col("neighbor_label")).alias("_neg")))
    return counts.groupBy("query_id").agg(best.alias("_b")).select(
        "query_id", (-F.col("_b._neg")).cast("long").alias(out))


def mean_vote(neighbours: DataFrame, out: str = "pred") -> DataFrame:
    """M5: mean neighbour label rounded half to even."""
    return neighbours.groupBy("query_id").agg(F.avg(F.col("neighbor_label").cast("double")).alias("mean_label")) \
        .withColumn(out, F.bround("mean_label", 0).cast("long"))


def knn_classify(queries: DataFrame, train: DataFrame, k: int, query_id: str, vec: str, train_id: str,
                 label: str, vote: str = "majority") -> DataFrame:
    nb = knn(queries, train, k, query_id, vec, train_id, vec, label)
    return majority_vote(nb) if vote == "majority" else mean_vote(nb)
