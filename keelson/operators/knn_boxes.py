"""Exact kNN over cells of training rows in shared files (L1 and what rides on it: M4, M5, R4).

1. A bounded sample of the training rows gives each group a tree of cuts, always of the widest coordinate at its median,
   with leaves of about CELL_ROWS rows.
2. Every training row goes to its leaf. A task sorts the leaves that it gets and writes them to one compressed file in the
   shared folder, in cells of at most twice CELL_ROWS rows, each with its box: least and largest value of every coordinate.
3. Query rows go to the leaves of the same trees, so those of a task lie close together. A task takes up to CHUNK_ROWS of a
   leaf at a time and reads cells from near to far: a query meets a cell only if the box is not farther than its k-th
   neighbour so far, by the same exact search as :mod:`~keelson.operators.knn`.

Each side is shuffled once and no query row is sent to several places, so the disk holds the rows of both sides and the
neighbours found, however many cells the queries meet. The files go when the neighbours are found.

Rows that are not finite, on either side, have a leaf of their own and take part in all pairs of their group, so the result is
that of the plain join: same order of ties, NaN distances last. The cuts affect the work only. Rounding is covered by a slack.
"""

from __future__ import annotations

import io
import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_packed, release, scratch_path
from ..sources.shared import open_shared

#: Rows and bytes of a cell, and bytes that the boxes of all cells may take (larger cells beyond).
CELL_ROWS, CELL_BYTES, BOX_BYTES = 4096, 8 << 20, 32 << 20
#: Sampled rows of a leaf, and bytes of the sample.
SAMPLE, SAMPLE_BYTES = 16, 16 << 20
#: Groups at most; more are small and left to the plain search.
MOST_GROUPS = 1024
#: Query rows that meet a cell at a time, and bytes of cells that a task keeps.
CHUNK_ROWS, KEPT_BYTES = 4096, 48 << 20
#: Bytes of training rows, and number of query rows, that a task is given.
TASK_BYTES, TASK_QUERIES, MOST_PARTITIONS = 32 << 20, 8192, 2048
SLACK = 1e-9
#: The leaf of rows that are not finite.
ODD = -1


class _Tree:
    """Cuts of one group: a row goes left where its coordinate ``dim`` is below ``cut``. A leaf has dim -1, its number and
    the pieces that its rows are dealt to where no cut makes it smaller."""

    def __init__(self, sample: np.ndarray, leaf_rows: float):
        self.dim, self.cut, self.child, self.leaf, self.pieces = [], [], [], [], []
        leaves, todo = 0, [(np.arange(len(sample)), None)]
        while todo:
            rows, link = todo.pop()
            node = len(self.dim)
            if link is not None:
                self.child[link[0]][link[1]] = node
            found = _cut(sample[rows]) if len(rows) > leaf_rows else None
            self.child.append([0, 0])
            self.dim.append(-1 if found is None else found[0])
            self.cut.append(0.0 if found is None else found[1])
            self.leaf.append(leaves if found is None else -1)
            self.pieces.append(max(1, int(len(rows) / (2 * leaf_rows))))
            if found is None:
                leaves += 1
            else:
                left = sample[rows, found[0]] < found[1]
                todo += [(rows[~left], (node, 1)), (rows[left], (node, 0))]  # the left one is next: near leaves, near numbers
        self.dim, self.cut, self.child, self.leaf, self.pieces = (np.array(x) for x in (self.dim, self.cut, self.child, self.leaf, self.pieces))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each row, ODD for rows that are not finite; and the leaf's pieces."""
        at, every = np.zeros(len(x), np.int64), np.arange(len(x))
        while (inner := self.dim[at] >= 0).any():
            some = every[inner]
            node = at[some]
            at[some] = self.child[node, (x[some, self.dim[node]] >= self.cut[node]).astype(np.int64)]
        return np.where(np.isfinite(x).all(axis=1), self.leaf[at], ODD), self.pieces[at]


def _cut(x: np.ndarray) -> tuple[int, float] | None:
    """(coordinate, value) of a cut with rows on both sides; None where all rows are equal."""
    with np.errstate(all="ignore"):
        spread = x.std(axis=0)
    low, high = x.min(axis=0), x.max(axis=0)
    spread = np.where(low < high, np.where(np.isfinite(spread) & (spread > 0), spread, np.finfo(np.float64).max), -1.0)
    dim = int(spread.argmax()) if len(spread) else 0
    if not len(spread) or spread[dim] < 0:
        return None
    values = np.sort(x[:, dim])
    middle = values[len(values) // 2]
    return dim, float(middle if middle > values[0] else values[np.searchsorted(values, middle, "right")])


def _per_group(batch: pa.RecordBatch, name: str):
    coded = batch.column(batch.schema.get_field_index(name)).dictionary_encode()
    codes = coded.indices.to_numpy()
    for k, g in enumerate(coded.dictionary.to_pylist()):
        yield g, np.flatnonzero(codes == k)


def _placed(rows: DataFrame, sent, width: int, training: bool) -> DataFrame:
    """Rows with their ``leaf`` and ``piece``; rows of groups without training rows are left out."""
    from .knn import _matrix

    columns = ["id", "vec", "label", "g"] if training else ["id", "vec", "g"]

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1), width)
                ids, leaf, piece, known = b.column(0).fill_null(0).to_numpy(), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, bool)
                for g, at in _per_group(b, "g"):
                    if g in sent.value:
                        leaf[at], pieces = sent.value[g].place(x[at])
                        piece[at], known[at] = ids[at] * 2_654_435_761 % (1 << 32) % pieces, True
                out = pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf), pa.array(piece)], [*columns, "leaf", "piece"])
                yield out if known.all() else out.filter(pa.array(known))

    kind = "id bigint, vec array<double>, label bigint, g string" if training else "id bigint, vec array<double>, g string"
    return rows.select(*columns).where(F.col("g").isNotNull()).mapInArrow(run, f"{kind}, leaf bigint, piece bigint")


def _runs(batches, most: int):
    """Tables of consecutive rows of the same group and leaf, of ``most`` rows but for the last."""
    held, key, n = [], None, 0
    for b in batches:
        if not b.num_rows:
            continue
        leaf = b.column(b.schema.get_field_index("leaf")).to_numpy()
        coded = b.column(b.schema.get_field_index("g")).dictionary_encode()
        code, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        begins = np.flatnonzero(np.append(True, (leaf[1:] != leaf[:-1]) | (code[1:] != code[:-1])))
        for s, e in zip(begins, [*begins[1:], b.num_rows]):
            here = (names[code[s]], int(leaf[s]))
            if here != key and held:
                yield key, pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
            key = here
            while s < e:
                part = b.slice(s, min(e - s, most - n))
                held.append(part)
                n += part.num_rows
                s += part.num_rows
                if n == most:
                    yield key, pa.Table.from_batches(held).combine_chunks()
                    held, n = [], 0
    if held:
        yield key, pa.Table.from_batches(held).combine_chunks()


INDEX = [("g", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("leaf", pa.int64()),
         ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))]


def _write_cells(placed: DataFrame, folder: str, cell_rows: int, per: int) -> list[pa.Table]:
    """Training rows to files; an index of the cells."""
    from .knn import _column, _matrix, _Train

    def run(batches):
        index, place, out = [], None, None
        for (g, leaf), t in _runs(batches, 2 * cell_rows):
            if out is None:
                fs, place = open_shared(f"{folder}/{uuid.uuid4().hex}")
                out, offset = fs.open_output_stream(place), 0
            ids, label, x = _column(t, "id").to_numpy(), _column(t, "label"), _matrix(_column(t, "vec"))
            block = _Train(ids, x, per)
            raw = io.BytesIO()
            for a in (ids, label.fill_null(0).to_numpy(), label.is_valid().to_numpy(zero_copy_only=False), block.members, block.kept, block.vectors.T):
                np.save(raw, np.ascontiguousarray(a))
            raw = raw.getvalue()
            data = len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)
            out.write(data)
            with np.errstate(all="ignore"):
                index.append((g, place, offset, len(data), leaf, block.vectors.min(axis=0).tolist(), block.vectors.max(axis=0).tolist()))
            offset += len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*index), INDEX)], [n for n, _ in INDEX])

    found = placed.mapInArrow(run, "g string, file string, offset bigint, length bigint, leaf bigint, low array<double>, high array<double>")
    return found.toArrow()


class _Cell:
    def __init__(self, data: bytes):
        raw = io.BytesIO(pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True))
        self.ids, self.label, self.labelled, members, kept, columns = (np.load(raw) for _ in range(6))
        from .knn import _Train

        self.train = _Train.of(np.ascontiguousarray(columns.T), members, kept)
        self.nbytes = self.train.vectors.nbytes + self.train.wide.nbytes + 48 * len(self.ids)


class _Cells:
    """The cells of one group, as queries meet them."""

    def __init__(self, index: pa.Table):
        self.file, self.offset, self.length, self.leaf = (index.column(c).to_pylist() for c in ("file", "offset", "length", "leaf"))
        box = lambda c: index.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(index.num_rows, -1)
        self.odd = np.array(self.leaf) == ODD
        self.low, self.high = np.where(self.odd[:, None], -np.inf, box("low")), np.where(self.odd[:, None], np.inf, box("high"))

    def far(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least squared distance of each cell's box to the box from ``low`` to ``high``; rows that are not finite come last."""
        return np.where(self.odd, np.inf, _gap(self.low - high, low - self.high))

    def far_from(self, cell: int, x: np.ndarray) -> np.ndarray:
        """Least squared distance of the cell's box to each row; 0 where one of them is not finite."""
        return _gap(self.low[cell] - x, x - self.high[cell])


def _gap(below: np.ndarray, above: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        gap = np.maximum(np.maximum(below, above), 0.0)
        far = np.einsum("ij,ij->i", gap, gap) * (1 - SLACK)
    return np.where(np.isnan(far), 0.0, far)


class _Reader:
    """Cells by file and place, the last ones kept."""

    def __init__(self, root: str):
        self.fs, self.held, self.files, self.size = open_shared(root)[0], OrderedDict(), OrderedDict(), 0

    def cell(self, file: str, offset: int, length: int) -> _Cell:
        found = self.held.get((file, offset))
        if found is None:
            source = self.files.get(file)
            if source is None:
                source = self.files[file] = self.fs.open_input_file(file)
                if len(self.files) > 64:
                    self.files.popitem(last=False)[1].close()
            found = self.held[file, offset] = _Cell(source.read_at(length, offset))
            self.size += found.nbytes
            while self.size > KEPT_BYTES and len(self.held) > 1:
                self.size -= self.held.popitem(last=False)[1].nbytes
        else:
            self.held.move_to_end((file, offset))
        return found


def _merged(best: tuple, more: tuple, k: int) -> tuple:
    """The k best of each row, of two sets of (rows, ids, distances, ...)."""
    both = [np.concatenate(c) for c in zip(best, more)]
    rows, ids, dist = both[:3]
    order = np.lexsort((ids, dist, rows))  # NaN sorts last
    rows = rows[order]
    keep = order[np.arange(len(rows)) - np.searchsorted(rows, rows, "left") < k]
    return tuple(c[keep] for c in both)


def _search(ids: np.ndarray, x: np.ndarray, cells: _Cells, leaf: int, reader: _Reader, k: int, exclude_self: bool, with_vectors: bool) -> tuple:
    """(rows, neighbour ids, distances, labels, whether there is a label, [vectors]) of the k nearest of each row of a chunk."""
    from .knn import _nearest

    kth = np.full(len(ids), np.inf)
    best = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64, np.int64, bool)) + ((np.zeros((0, x.shape[1])),) if with_vectors else ())
    far = np.zeros(len(cells.leaf)) if leaf == ODD else cells.far(x.min(axis=0), x.max(axis=0))
    own = np.array(cells.leaf) == leaf
    for c in np.lexsort((far, ~own)):
        if far[c] > kth.max():
            if own[c]:
                continue
            break  # the others are farther
        at = np.flatnonzero(far[c] <= kth)
        at = at[cells.far_from(c, x[at]) <= kth[at]]
        if not len(at):
            continue
        cell = reader.cell(cells.file[c], cells.offset[c], cells.length[c])
        bound = kth[at] * (1 + SLACK) + 1e-300
        rows, members, dist = _nearest(x[at], cell.ids, cell.train, k, ids[at] if exclude_self else None, bound)
        if len(rows):
            more = (at[rows], cell.ids[members], dist, cell.label[members], cell.labelled[members])
            if with_vectors:
                place = np.empty(len(cell.ids), np.int64)
                place[cell.train.members] = np.repeat(np.arange(len(cell.train.kept)), cell.train.kept)
                more += (cell.train.vectors[place[members]],)
            best = _merged(best, more, k)
            full = np.flatnonzero(np.bincount(best[0], minlength=len(ids)) >= k)
            last = best[2][np.searchsorted(best[0], full, "right") - 1]
            kth[full] = np.where(np.isnan(last), np.inf, last)
    return best


def _found(queries: DataFrame, sent, folder: str, k: int, exclude_self: bool, with_vectors: bool) -> DataFrame:
    """Neighbours of the query rows, by chunks of a leaf."""
    from .knn import _column, _matrix, neighbour_schema

    names = ["query_id", "neighbor_id", "neighbor_label", "dist", *(["neighbor_vec"] if with_vectors else [])]

    def run(batches):
        reader = _Reader(folder)
        for (g, leaf), q in _runs(batches, CHUNK_ROWS):
            if g in sent.value:
                ids, x = _column(q, "id").to_numpy(), _matrix(_column(q, "vec"))
                rows, near, dist, label, labelled, *vec = _search(ids, x, sent.value[g], leaf, reader, k, exclude_self, with_vectors)
                columns = [pa.array(ids[rows], pa.int64()), pa.array(near, pa.int64()), pa.array(label, pa.int64(), mask=~labelled), pa.array(dist, pa.float64())]
                if with_vectors:
                    flat = pa.array(vec[0].reshape(-1), pa.float64())
                    columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * x.shape[1], pa.int32()), flat))
                yield pa.RecordBatch.from_arrays(columns, names)

    return queries.mapInArrow(run, neighbour_schema(with_vectors))


def _trees(t: DataFrame, n: int, width: int, cell_rows: int, groups: list[str]) -> dict[str, _Tree]:
    """Cuts from a sample by a hash of the rows."""
    most = max(1024, SAMPLE_BYTES // (8 * width))
    share = min(1.0, min(most, SAMPLE * max(64, n / cell_rows)) / max(1, n))
    cut = int(share * (1 << 32))
    rows = t.where(F.col("g").isNotNull() & (F.pmod(F.xxhash64("id", "vec"), F.lit(1 << 32)) < cut)).select("g", "vec")
    sample = rows.limit(2 * most).toArrow().combine_chunks()
    from .knn import _column, _matrix

    x, by = _matrix(_column(sample, "vec"), width) if sample.num_rows else np.zeros((0, width)), {}
    if sample.num_rows:
        by = {g: x[at][np.isfinite(x[at]).all(axis=1)] for g, at in _per_group(sample.to_batches()[0], "g")}
    return {g: _Tree(by.get(g, np.zeros((0, width))), max(2.0, cell_rows * share)) for g in groups}


def knn_boxes(q: DataFrame, t: DataFrame, sizes: DataFrame, k: int, exclude_self: bool = False, with_vectors: bool = False,
              cell_rows: int = CELL_ROWS) -> DataFrame | None:
    """Neighbours as :func:`~keelson.operators.knn.knn` returns them, of sides (is_query, id, vec, label, g) and the ``sizes``
    of their groups. None where there are too many groups."""
    from .knn import k_best

    spark = t.sparkSession
    held = sizes.where(F.col("g").isNotNull()).limit(MOST_GROUPS + 1).collect()
    if len(held) > MOST_GROUPS:
        return None
    n, n_q, width = sum(r["n_t"] for r in held), sum(r["n_q"] for r in held), max([r["d"] for r in held], default=1)
    cell_rows = max(1, min(cell_rows, CELL_BYTES // (8 * width)), -(-n // max(1, BOX_BYTES // (16 * width))))
    sent = spark.sparkContext.broadcast(_trees(t, n, width, cell_rows, [r["g"] for r in held if r["n_t"]]))
    folder = scratch_path(spark, f"knn/{uuid.uuid4().hex}")
    fs, place = open_shared(folder)
    fs.create_dir(place, recursive=True)
    try:
        cores = spark.sparkContext.defaultParallelism
        parts = min(MOST_PARTITIONS, max(cores, -(-n * (8 * width + 48) // TASK_BYTES)))
        key = ["g", "leaf", "piece"]
        index = _write_cells(_placed(t, sent, width, True).repartition(parts, *key).sortWithinPartitions(*key), folder, cell_rows, k + (1 if exclude_self else 0))
        release(spark)
        cells = {g: _Cells(index.filter(pc.equal(index.column("g"), g))) for g in index.column("g").unique().to_pylist()}
        cells = spark.sparkContext.broadcast(cells)
        parts = min(MOST_PARTITIONS, max(3 * cores, -(-n_q // TASK_QUERIES)))
        order = ["g", "leaf", F.xxhash64("id")]
        near = cut_packed(_found(_placed(q, sent, width, False).repartitionByRange(parts, *order).sortWithinPartitions(*order[:2]), cells, folder, k, exclude_self, with_vectors))
    finally:
        fs.delete_dir(place)
        release(spark)
    return k_best(near, k)
