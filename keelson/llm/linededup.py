"""Line dedup by a sharded minimal perfect hash over distinct line hashes.

1. Tasks cut whole texts into lines and hash each line's key (stripped, A-Z lower-cased) to 128 bits. Two groupings,
   first by (line, document), then by line, both combined before the shuffle, count the documents of each line; a line
   that every document has is spread over all tasks by the document.
2. The lines that are in ``min_docs`` documents or more are dealt to shards by the leading bits of their hash. A task per
   shard builds a minimal perfect hash (levels of bit arrays with ranks: a hash alone at its place of a level takes that
   place, the others go to the next level) and writes it with three arrays in its order: fingerprints, counts of
   documents, last document.
3. Documents are read again and probe the arrays, shard by shard in the order of the hashes; no line is joined. A line
   that is not in the index meets another one's fingerprint, so it is left alone.

Place and fingerprint are two different 64-bit halves of the hash: a line is taken for another one only if all 128 bits
are equal. Shards hold about SHARD_KEYS lines each however many there are; a worker keeps HELD_SHARDS of them mapped at
most (read into memory where the shared folder is not mounted) and finds them by a manifest in the shared folder. The
driver gets one number, the count of indexed lines.

Defined results: a null or empty text is one empty line, and so is the kept text of one that loses all its lines; rows
with the same id are one document, which keeps its lines in all its rows if it is the last; a null id counts as one
document before all others; a very long text is cut whole, in a batch of its own; of an empty table nothing is indexed
and the result is empty; other columns are ignored unless ``carry`` names them.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _CACHES, SPACE, byte_slices, keep_only, materialize, shared_path, ship
from .lm import map_arrays, write_arrays
from .tokenfile import open_fs

#: Keys of fewer code points are never dropped; neither are those of fewer documents.
MIN_CHARS, MIN_DOCS = 20, 3
#: Lines per shard of the index, and shards that a worker holds at a time.
SHARD_KEYS, HELD_SHARDS = 1 << 18, 256
#: Places of a level for each hash that is left, and levels before the rest is listed.
GAMMA, LEVELS = 2.0, 48
#: Text bytes cut into lines together.
SLICE = 8 << 20
#: The id of documents without one.
NO_ID = -(1 << 63)
ARRAYS = ["<u8", "<u4", "<u8", "<u4", "<i8", "<u8"]
SHARD = "shard bigint, path string, n bigint, levels array<bigint>, sizes array<bigint>"


def cut_lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lines of a text column without nulls, and the begins of the rows' lines (one more than rows)."""
    lists = pc.split_pattern(texts, "\n")
    bounds = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten(), bounds - bounds[0]


def line_hashes(lines: pa.Array, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the lines whose key is long enough, each one's row in ``hashes``, (n, 2) hashes of distinct keys)."""
    import xxhash

    keys = pc.ascii_lower(pc.ascii_trim(lines, characters=SPACE))
    at = np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), min_chars).to_numpy(zero_copy_only=False))
    coded = keys.take(pa.array(at)).dictionary_encode()
    distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, distinct)), "<u8").reshape(-1, 2)
    return at, coded.indices.to_numpy(), hashes


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(h: np.ndarray, level: int, size: int) -> np.ndarray:
    """The places of (n, 2) hashes in a level of ``size`` bits."""
    return _scrambled(h[:, 0] ^ _scrambled(h[:, 1] + np.uint64(level + 1))) % np.uint64(size)


class PerfectHash:
    """A minimal perfect hash of distinct (n, 2) hashes: 0 .. n - 1 for them, anything or -1 for others."""

    def __init__(self, levels: list[int], bits: np.ndarray, ranks: np.ndarray, rest: np.ndarray):
        self.levels, self.bits, self.ranks, self.rest = levels, bits, ranks, rest.reshape(-1, 2)
        self.first = int(ranks[-1]) if len(ranks) else 0  # numbers of the listed rest follow

    @classmethod
    def build(cls, h: np.ndarray, gamma: float = GAMMA, most: int = LEVELS) -> "PerfectHash":
        left, levels, words = h, [], []
        while len(left) and len(levels) < most:
            size = 64 * math.ceil(max(1.0, gamma * len(left)) / 64)
            at = _places(left, len(levels), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            levels.append(size)
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at.astype(np.int64)]]
        bits = np.concatenate(words) if words else np.zeros(0, "<u8")
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)]).astype("<u4")
        return cls(levels, bits, ranks, np.ascontiguousarray(left))

    def numbers(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        left, base = np.arange(len(h)), 0
        for level, size in enumerate(self.levels):
            if not len(left):
                return out
            at = _places(h[left], level, size)
            word = base + (at >> np.uint64(6)).astype(np.int64)
            held, bit = self.bits[word], at & np.uint64(63)
            hit = (held >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(held & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (self.ranks[word].astype(np.int64) + below)[hit]
            left, base = left[~hit], base + size // 64
        for k, pair in enumerate(self.rest):
            out[left[(h[left] == pair).all(axis=1)]] = self.first + k
        return out


def count_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, text) -> (h1, h2, n, last): documents of each line's key, and the last of them."""

    def run(batches):
        keep_only("linededup")
        for batch in batches:
            for part in byte_slices(batch, 1, SLICE):
                lines, bounds = cut_lines(part.column(1))
                at, codes, hashes = line_hashes(lines, min_chars)
                row = np.searchsorted(bounds, at, "right") - 1
                once = np.unique(row * max(1, len(hashes)) + codes)  # a line counts once in a row
                row, h = once // max(1, len(hashes)), hashes[once % max(1, len(hashes))].view("<i8")
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), part.column(0).take(pa.array(row))], ["h1", "h2", "id"])

    pairs = docs.mapInArrow(run, "h1 bigint, h2 bigint, id bigint").groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
    return pairs.groupBy("h1", "h2").agg(F.count("one").alias("n"), F.max("id").alias("last"))


def write_index(counts: DataFrame, folder: str, bits: int) -> str:
    """Write the 2^bits shards of (h1, h2, n, last); returns the manifest's path (a Parquet table, one row per shard)."""

    def build(key, table):
        h = np.column_stack([table.column(c).to_numpy().view("<u8") for c in ("h1", "h2")])
        index = PerfectHash.build(h)
        order = np.argsort(index.numbers(h))
        n = np.minimum(table.column("n").to_numpy(), (1 << 32) - 1)
        arrays = [index.bits, index.ranks, h[order, 1], n[order].astype("<u4"), table.column("last").to_numpy()[order], index.rest.reshape(-1)]
        return pa.Table.from_pylist([{"shard": key[0].as_py(), "path": write_arrays(folder, "lines", arrays), "n": len(h), "levels": index.levels,
                                      "sizes": [len(a) for a in arrays]}], MANIFEST_SCHEMA)

    shard = F.shiftrightunsigned("h1", 64 - bits) if bits else F.lit(0).cast("bigint")
    rows = counts.withColumn("shard", shard).groupBy("shard").applyInArrow(build, SHARD)
    path = shared_path(counts.sparkSession, "line-manifest")
    rows.write.parquet(path)
    return path


MANIFEST_SCHEMA = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n", pa.int64()), ("levels", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])


class LineIndex:
    """The shards behind a manifest, mapped when they are first probed."""

    def __init__(self, manifest: str):
        import pyarrow.dataset as ds
        from pyarrow.fs import FileSelector

        fs, place = open_fs(manifest)
        files = [f.path for f in fs.get_file_info(FileSelector(place)) if f.path.endswith(".parquet")]
        rows = ds.dataset(files, schema=MANIFEST_SCHEMA, filesystem=fs, format="parquet").to_table().sort_by("shard") if files else MANIFEST_SCHEMA.empty_table()
        self.rows, self.shards = rows, rows.column("shard").to_numpy()
        self.held = lru_cache(maxsize=HELD_SHARDS)(self._open)

    def _open(self, k: int):
        r = self.rows.slice(k, 1).to_pylist()[0]
        bits, ranks, prints, counts, last, rest = map_arrays(r["path"], r["sizes"], ARRAYS)
        return PerfectHash(r["levels"], bits, ranks, rest), prints, counts, last

    def probe(self, h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, last document) of (n, 2) hashes; 0 documents for what is not listed."""
        n, last = np.zeros(len(h), np.int64), np.full(len(h), NO_ID, np.int64)
        shard = (h[:, 0] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
        order = np.argsort(shard, kind="stable")
        begins = np.searchsorted(shard[order], self.shards, "left"), np.searchsorted(shard[order], self.shards, "right")
        for k, (b, e) in enumerate(zip(*begins)):
            if b < e:
                at = order[b:e]
                index, prints, counts, lasts = self.held(k)
                number = index.numbers(h[at])
                at, number = at[number >= 0], number[number >= 0]
                same = prints[number] == h[at, 1]
                n[at[same]], last[at[same]] = counts[number[same]], lasts[number[same]]
        return n, last


@lru_cache(maxsize=1)
def worker_index(manifest: str) -> LineIndex:
    return LineIndex(manifest)


_CACHES["linededup"] = worker_index.cache_clear


def drop_lines(docs: DataFrame, manifest: str, bits: int, min_chars: int, min_docs: int) -> DataFrame:
    """(id, text, ...) -> the same with the kept text, ``n_lines`` and ``n_dropped``."""

    def run(batches):
        keep_only("linededup")
        index = worker_index(manifest)
        for batch in batches:
            for part in byte_slices(batch, 1, SLICE):
                ids = part.column(0).to_numpy()
                lines, bounds = cut_lines(part.column(1))
                at, codes, hashes = line_hashes(lines, min_chars)
                n, last = (x[codes] for x in index.probe(hashes, bits))
                owner = ids[np.searchsorted(bounds, at, "right") - 1]
                drop = np.zeros(len(lines), bool)
                drop[at[(n >= min_docs) & (last != owner)]] = True
                gone = np.concatenate([[0], np.cumsum(drop)])[bounds]
                kept = pa.ListArray.from_arrays(pa.array((bounds - gone).astype(np.int32)), lines.filter(pa.array(~drop)))
                columns = [part.column(0), pc.binary_join(kept, "\n"), *part.columns[2:], pa.array(np.diff(bounds)), pa.array(np.diff(gone))]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "n_lines", "n_dropped"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, n_lines bigint, n_dropped bigint")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                shard_keys: int = SHARD_KEYS, carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: (id, text that is kept, [row,] n_lines before, n_dropped)."""
    spark = docs.sparkSession
    ship(spark)
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID))
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    counts = materialize(count_lines(docs.select(key.alias("id"), text), min_chars).filter(F.col("n") >= min_docs), "line-counts")
    bits = math.ceil(math.log2(max(1, counts.count() / shard_keys)))
    manifest = write_index(counts, shared_path(spark, "line-index"), bits)
    row = [F.struct(F.col(id_col).alias("id"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry or [])]).alias("row")]
    out = drop_lines(docs.select(key.alias("id"), text, *row), manifest, bits, min_chars, min_docs)
    carried = [F.struct(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(carry)]).alias("row")] if carry else []
    return out.select(F.col("row.id").alias("id"), "text", *carried, "n_lines", "n_dropped")


def op11_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT rid, doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.rid, k.doc_id, k.i, k.line, coalesce(c.last <> k.doc_id, false) AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id
"""
