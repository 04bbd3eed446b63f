"""Language-model scoring: an interpolated modified Kneser-Ney n-gram model, counted in Spark, memory-mapped by workers.

Tokens are words with A-Z lower-cased, then one end per text. The model is a set of sorted arrays in the shared folder:

* vocabulary: segments of sorted 64-bit word hashes with their counts; a word's number is its place in that order;
* statistics, by word number: continuation count; as a context: total, and how many followers seen once, twice, more;
* n-grams: shards of sorted 64-bit keys (context number, word number), below each its sorted words to the left, and so
  on up to the model's order, with the counts of the longest;
* contexts of two and more words that occur more than once: the same statistics (one that occurs once has one follower,
  seen once, and is known from the n-gram that it is).

Counting is three groupings. (1) Word counts. (2) Tasks combine the n-grams that they see into sorted packed arrays by
bucket of the number of the last word but one, v; a task per bucket merges them and writes its shard: all orders of what
ends in v w, and all contexts that end in v, lie in one bucket. A frequent v (any that holds more than a quarter of a
mean bucket) is dealt by the last word's number instead, so no bucket hangs on one word. (3) Partial statistics are
merged by range of word numbers, those of the longer contexts that end in a frequent v by that of the word before. What
is gathered is all training text; nothing is capped or pruned. The driver sees the rows of files (up to three per bucket
for order 3) and the frequent contexts (at most 4 per bucket).

Scoring reads whole texts and looks words and bigrams up in memory maps of the files, batch by batch in sorted order; a
worker opens the files that a batch needs and keeps HELD_FILES of each kind mapped at most.
The maps need the shared folder to be mounted on the workers; from other file systems the arrays are read into memory.

p(w | u v) = max(c(uvw) - D(c(uvw)), 0) / c(uv.) + g(uv) p(w | v), g(uv) = (D1 N1(uv.) + D2 N2(uv.) + D3 N3+(uv.)) / c(uv.),
and p(w | v) and p(w) the same over continuation counts (of n-grams that start with the begin of a text: counts),
interpolated at last with 1 / (V + 1); an unseen context leaves the shorter one's value, and so does a text's start where
fewer words precede. The order is a parameter; the query registers ORDER.

Defined results: a null or empty text is the end token alone; without training text (empty table, or none to learn from)
V = N = 0 and every token has probability 1; repeated rows are learned and scored each; a row without id is learned
from; other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _CACHES, byte_slices, hashed_words, keep_only, materialize, shared_path, ship, text_or_empty
from .tokenfile import open_fs

#: Hash of the end token: of a word that cannot occur.
END = np.uint64(0x5BD1E9955BD1E995)
#: Tokens that a task combines before it hands them on, tokens per bucket, text bytes taken together.
FLUSH, BUCKET, SLICE = 4_000_000, 2_000_000, 4 << 20
#: The order of the registered model.
ORDER = 3
HALF, LOW = np.uint64(32), np.uint64(0xFFFFFFFF)


def pack(a: np.ndarray, differences: bool = True) -> bytes:
    """Byte planes of the differences of a sorted (or any) integer array, or of its values, compressed."""
    import zstandard

    a = a.astype(np.int64) if a.dtype == bool else a
    d = np.diff(a, prepend=a.dtype.type(0)) if differences else np.ascontiguousarray(a)
    return len(a).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(d.view(np.uint8).reshape(-1, a.itemsize).T.tobytes())


def unpack(data: bytes, dtype, differences: bool = True) -> np.ndarray:
    import zstandard

    n, size = int.from_bytes(data[:8], "little"), np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:]), np.uint8).reshape(size, n)
    d = np.ascontiguousarray(raw.T).reshape(-1).view(dtype)
    return np.cumsum(d, dtype=dtype) if differences else d


def write_arrays(folder: str, name: str, arrays: list[np.ndarray]) -> str:
    """Write arrays one after the other to a new file of the shared folder; returns its path."""
    path = f"{folder}/{name}-{uuid.uuid4().hex}.bin"
    fs, place = open_fs(path)
    fs.create_dir(os.path.dirname(place), recursive=True)
    with fs.open_output_stream(place) as out:
        for a in arrays:
            out.write(np.ascontiguousarray(a))
    return path


def map_arrays(path: str, n: int | list[int], dtypes: list[str]) -> list[np.ndarray]:
    """The arrays of a file, of length n or of one length each, memory-mapped where the file system is mounted."""
    lengths = [n] * len(dtypes) if isinstance(n, int) else n
    fs, place = open_fs(path)
    if fs.type_name == "local":
        held = np.memmap(place, np.uint8, "r") if any(lengths) else np.zeros(0, np.uint8)
    else:
        with fs.open_input_file(place) as f:
            held = np.frombuffer(f.read_buffer(), np.uint8)
    out, at = [], 0
    for d, n in zip(dtypes, lengths):
        size = n * np.dtype(d).itemsize
        out.append(held[at:at + size].view(d))
        at += size
    return out


@contextmanager
def small_batches(spark, rows: int = 16):
    """Arrow batches of few rows, for rows that hold packed arrays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Signed hashes of all tokens (each text's words, then the end) and the begins of the texts' tokens."""
    words, bounds = hashed_words(texts)
    rows = len(bounds) - 1
    out = np.empty(len(words) + rows, np.uint64)
    ends = bounds[1:] + np.arange(rows)
    is_end = np.zeros(len(out), bool)
    is_end[ends] = True
    out[is_end], out[~is_end] = END, words
    return out.view(np.int64), bounds + np.arange(rows + 1)


#: Files that a worker keeps mapped at a time, of each kind.
HELD_FILES = 1024


class Mapped:
    """The arrays of many files by key, mapped when they are first asked for; the HELD_FILES used last stay mapped."""

    def __init__(self, files: dict):
        self.files, self.held = files, {}

    def get(self, key):
        """The arrays, or None for a key without a file."""
        if key not in self.files:
            return None
        found = self.held.pop(key, None)
        if found is None:
            found = map_arrays(*self.files[key])
            if len(self.held) >= HELD_FILES:
                self.held.pop(next(iter(self.held)))
        self.held[key] = found
        return found


class Vocabulary:
    """Word hash -> number (place in the order of hashes); ``size`` for none, size + 1 for the begin of a text."""

    def __init__(self, segments: list[tuple[int, int, int, str]]):
        self.size = sum(s[1] for s in segments)
        self.firsts = np.array([s[0] for s in segments], np.int64)
        self.offsets = np.array([s[2] for s in segments], np.int64)
        self.maps = Mapped({k: (s[3], s[1], ["<i8", "<i8"]) for k, s in enumerate(segments)})

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, counts) of sorted distinct hashes."""
        out, counts = np.full(len(hashes), self.size, np.int64), np.zeros(len(hashes), np.int64)
        if not len(self.firsts):
            return out, counts
        segment = np.searchsorted(self.firsts, hashes, "right") - 1
        for k in np.unique(segment[segment >= 0]).tolist():
            b, e = np.searchsorted(segment, [k, k + 1])
            keys, held = self.maps.get(k)
            at = np.minimum(np.searchsorted(keys, hashes[b:e]), len(keys) - 1)
            hit = keys[at] == hashes[b:e]
            out[b:e][hit] = at[hit] + self.offsets[k]
            counts[b:e][hit] = held[at[hit]]
        return out, counts


@lru_cache(maxsize=2)
def worker_vocabulary(segments: tuple) -> Vocabulary:
    return Vocabulary(list(segments))


def count_words(train: DataFrame) -> DataFrame:
    """(h, c): the training tokens' hashes and counts, combined in tasks before the shuffle."""

    def run(batches):
        keep_only("lm")
        held, size = [], 0

        def combined():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(c.astype(np.int64))], ["h", "c"])

        for batch in batches:
            for part in byte_slices(batch, 0, SLICE):
                held.append(token_hashes(part.column(0))[0])
                size += len(held[-1])
                if size >= FLUSH:
                    yield combined()
                    held, size = [], 0
        if held:
            yield combined()

    return train.mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


def write_vocabulary(counts: DataFrame, folder: str) -> tuple[tuple[int, int, int, str], ...]:
    """Write the sorted segments; (first hash, words, number of the first, path) of each, in order."""

    def run(batches):
        keep_only("lm")
        batches = [b for b in batches if b.num_rows]
        if batches:
            h, c = (np.concatenate([b.column(k).to_numpy() for b in batches]) for k in range(2))
            yield pa.RecordBatch.from_pylist([{"first": int(h[0]), "n": len(h), "total": int(c.sum()), "path": write_arrays(folder, "words", [h, c])}])

    ordered = counts.repartitionByRange("h").sortWithinPartitions("h")
    rows = materialize(ordered.mapInArrow(run, "first bigint, n bigint, total bigint, path string"), "lm-words").orderBy("first").collect()
    out, at = [], 0
    for r in rows:
        out.append((r["first"], r["n"], at, r["path"]))
        at += r["n"]
    return tuple(out), sum(r["total"] for r in rows)


def ngram_words(hashes: np.ndarray, begins: np.ndarray, vocabulary: Vocabulary, order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(context number and word number as one key, the ``order`` - 2 words further left, word counts) of all tokens; to
    the left of a text's first token there are begins only."""
    distinct, place = np.unique(hashes, return_inverse=True)
    numbers, counts = vocabulary.numbers(distinct)
    w = numbers[place].astype(np.uint64)
    left = [w]
    for _ in range(order - 1):
        v = np.empty_like(w)
        v[1:] = left[-1][:-1]
        v[begins[:-1]] = vocabulary.size + 1
        left.append(v)
    return left[1] << HALF | w, left[2:], counts[place]


def combine(pairs: np.ndarray, lefts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The distinct rows as sorted levels, and each row's place in each of them. The first level holds pairs, a further
    one (place in the level before, word to the left)."""
    key, place = np.unique(pairs, return_inverse=True)
    levels, places = [key], [place]
    for left in lefts:
        key, place = np.unique(place.astype(np.uint64) << HALF | left, return_inverse=True)
        levels.append(key)
        places.append(place)
    return levels, places


def spread(levels: list[np.ndarray]) -> list[np.ndarray]:
    """Pairs and words to the left of each entry of the last level."""
    at, out = np.arange(len(levels[-1])), []
    for key in levels[:0:-1]:
        out.append(key[at] & LOW)
        at = (key[at] >> HALF).astype(np.int64)
    return [levels[0][at], *out[::-1]]


def context_keys(levels: list[np.ndarray]) -> list[np.ndarray]:
    """Keys of the contexts (n-grams without their last word) of each level: of one word its number, of two both
    numbers, of more a 64-bit hash."""
    out = [levels[0] >> HALF]
    for k, key in enumerate(levels[1:], 1):
        before, word = out[-1][(key >> HALF).astype(np.int64)], key & LOW
        out.append(before << HALF | word if k == 1 else mixed(before, word))
    return out


def mixed(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + word
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def deal(v: np.ndarray, w: np.ndarray, hot: np.ndarray, buckets: int, words: int) -> np.ndarray:
    """The bucket of n-grams that end in v, w: by range of context numbers, frequent contexts by range of word numbers."""
    by = np.where(np.isin(v, hot), w, v)
    return np.minimum(by * buckets // (words + 2), buckets - 1)


def halves(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (pairs >> HALF).astype(np.int64), (pairs & LOW).astype(np.int64)


def map_ngrams(train: DataFrame, segments: tuple, hot: np.ndarray, buckets: int, order: int) -> DataFrame:
    """(bucket, keys, lefts, counts): packed combined n-grams of the model's order."""

    def run(batches):
        keep_only("lm")
        vocabulary = worker_vocabulary(segments)
        held, size = [], 0

        def flush():
            pairs, *lefts = (np.concatenate(c) for c in zip(*held))
            levels, places = combine(pairs, lefts)
            counts = np.bincount(places[-1])
            pairs, *lefts = spread(levels)
            at = deal(*halves(pairs), hot, buckets, vocabulary.size)
            rank = np.argsort(at, kind="stable")
            pairs, lefts, counts, at = pairs[rank], [x[rank].astype(np.uint32) for x in lefts], counts[rank], at[rank]
            cuts = np.flatnonzero(np.diff(at)) + 1
            for b, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
                row = {"bucket": int(at[b]), "keys": pack(pairs[b:e]), "lefts": [pack(x[b:e], False) for x in lefts], "counts": pack(counts[b:e].astype(np.int64))}
                yield pa.RecordBatch.from_pylist([row], PACKED_SCHEMA)

        for batch in batches:
            for part in byte_slices(batch, 0, SLICE):
                pairs, lefts, _ = ngram_words(*token_hashes(part.column(0)), vocabulary, order)
                held.append((pairs, *lefts))
                size += len(pairs)
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return train.mapInArrow(run, "bucket bigint, keys binary, lefts array<binary>, counts binary")


def _sums(ids: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct ids (sorted) and the sums of each of ``values``."""
    distinct, place = np.unique(ids, return_inverse=True)
    return distinct, *(np.bincount(place, weights=v, minlength=len(distinct)).astype(np.int64) for v in values)


PACKED_SCHEMA = pa.schema([("bucket", pa.int64()), ("keys", pa.binary()), ("lefts", pa.list_(pa.binary())), ("counts", pa.binary())])
SHARD = "kind string, bucket bigint, path string, sizes array<bigint>, ids binary, stats array<binary>, seen array<bigint>"
SHARD_SCHEMA = pa.schema([("kind", pa.string()), ("bucket", pa.int64()), ("path", pa.string()), ("sizes", pa.list_(pa.int64())), ("ids", pa.binary()),
                          ("stats", pa.list_(pa.binary())), ("seen", pa.list_(pa.int64()))])


#: Totals of contexts from which on they are kept apart, with 64 bits.
LARGE = (1 << 32) - 1
CONTEXT = ["<u8", *["<u4"] * 4, "<u8", "<u8"]


def context_arrays(keys: np.ndarray, stats: list[np.ndarray]) -> list[np.ndarray]:
    """What is kept of contexts of two and more words: those that occur once are known from their own n-gram. Totals of
    LARGE and more are LARGE in their array; places and totals of those follow. (Followers are distinct words, of which
    there are fewer than LARGE.)"""
    many = stats[0] > 1
    keys, (total, *seen) = keys[many], [s[many].astype(np.int64) for s in stats]
    large = np.flatnonzero(total >= LARGE)
    return [keys, np.minimum(total, LARGE).astype("<u4"), *(s.astype("<u4") for s in seen), large.astype("<u8"), total[large].astype("<u8")]


def context_statistics(held: list[np.ndarray], place: np.ndarray) -> list[np.ndarray]:
    """The 4 statistics of the contexts at ``place`` of :func:`context_arrays`."""
    total, *seen = (a[place].astype(np.int64) for a in held[1:5])
    large = np.flatnonzero(total == LARGE)
    total[large] = held[6][np.searchsorted(held[5], place[large].astype(np.uint64))]
    return [total, *seen]


def merge_ngrams(packed: DataFrame, folder: str, hot: np.ndarray, buckets: int, words: int, order: int) -> DataFrame:
    """Write each bucket's shard and its contexts; rows of kind ``shard`` and ``cold3`` .. (files; counts of counts by
    order), and packed partial statistics: of kind ``word`` (continuations) and ``context`` by range of word numbers,
    of kind ``hot3`` .. the longer contexts that end in a frequent word."""
    rows = packed.repartition("bucket").sortWithinPartitions("bucket")

    def parts(kind, ids, stats, at):
        cuts = np.flatnonzero(np.diff(at)) + 1
        for b, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]) if len(at) else ():
            yield {"kind": kind, "bucket": int(at[b]), "ids": pack(ids[b:e]), "stats": [pack(s[b:e]) for s in stats]}

    def finish(bucket, held):
        pairs, *lefts, counts = (np.concatenate(c) for c in zip(*held))
        levels, places = combine(pairs, [x.astype(np.uint64) for x in lefts])
        counts = np.bincount(places[-1], weights=counts).astype(np.int64)
        begin, parents = np.uint64(words + 1), [(k >> HALF).astype(np.int64) for k in levels[1:]]
        v, w = halves(levels[0])
        first = [v == words + 1, *((k & LOW) == begin for k in levels[1:])]
        # counts by level: of occurrences in the last one and behind a begin, else of different words to the left
        raw = [counts]
        for parent, below in zip(parents[::-1], levels[:0:-1]):
            raw.insert(0, np.bincount(parent, weights=raw[0]).astype(np.int64))
        adjusted = [np.where(f, r, np.bincount(p)) for f, r, p in zip(first, raw, parents)] + [counts]
        real = [np.ones(len(v), bool), *(~f[p] for f, p in zip(first, parents))]  # at most one begin
        seen = [int((a[r] == k).sum()) for a, r in zip(adjusted, real) for k in range(1, 5)]
        many = np.flatnonzero(counts >= 255)
        starts = [np.searchsorted(p, np.arange(len(k) + 1)).astype("<u4") for p, k in zip(parents, levels)]
        arrays = [levels[0], many.astype("<u8"), counts[many].astype("<u8"), *starts, *((k & LOW).astype("<u4") for k in levels[1:]), np.minimum(counts, 255).astype("u1")]
        out = [{"kind": "shard", "bucket": bucket, "path": write_arrays(folder, "ngrams", arrays), "sizes": [len(a) for a in arrays], "seen": seen}]
        by_range = lambda ids: np.minimum(ids * buckets // (words + 2), buckets - 1)
        for kind, (ids, *stats) in (("word", _sums(w, np.ones(len(w)))), ("context", _sums(v, *kinds(adjusted[0])))):
            out.extend(parts(kind, ids, stats, by_range(ids)))
        at, above = v, None
        for k, (keys, a, r) in enumerate(zip(context_keys(levels), adjusted, real)):
            if k == 0:
                continue
            # the context's last two words decide where it lies
            at = at[parents[k - 1]]
            above = (levels[1] & LOW).astype(np.int64) if k == 1 else above[parents[k - 1]]
            frequent = np.isin(at, hot)
            keep = r & ~frequent
            ids, *stats = _sums(keys[keep], *kinds(a[keep]))
            arrays = context_arrays(ids, stats)
            out.append({"kind": f"cold{k + 2}", "bucket": bucket, "path": write_arrays(folder, "contexts", arrays), "sizes": [len(x) for x in arrays]})
            keep = r & frequent
            if keep.any():
                place = deal(at[keep], above[keep], hot, buckets, words)
                # contexts by bucket, then by key
                for b in np.unique(place):
                    ids, *stats = _sums(keys[keep][place == b], *kinds(a[keep][place == b]))
                    out.extend(parts(f"hot{k + 2}", ids, stats, np.full(len(ids), b)))
        return pa.RecordBatch.from_pylist([{n: row.get(n) for n in SHARD_SCHEMA.names} for row in out], SHARD_SCHEMA)

    def run(batches):
        keep_only("lm")
        bucket, held = None, []
        for batch in batches:
            for b, k, x, c in zip(*(col.to_pylist() for col in batch.columns)):
                if b != bucket and held:
                    yield finish(bucket, held)
                    held = []
                bucket = b
                held.append((unpack(k, np.uint64), *(unpack(y, np.uint32, False) for y in x), unpack(c, np.int64)))
        if held:
            yield finish(bucket, held)

    return rows.mapInArrow(run, SHARD)


def kinds(counts: np.ndarray) -> list[np.ndarray]:
    """What contexts sum up of their followers' counts: total, and how many are one, two, more."""
    return [counts, counts == 1, counts == 2, counts > 2]


def merge_contexts(parts: DataFrame, folder: str) -> DataFrame:
    """(kind, bucket, path, sizes): the longer contexts that end in a frequent word, each with all its followers."""
    rows = parts.select("bucket", "kind", "ids", "stats").repartition("bucket").sortWithinPartitions("bucket", "kind")

    def finish(bucket, kind, held):
        ids, *stats = _sums(*(np.concatenate(c) for c in zip(*held)))
        arrays = context_arrays(ids, stats)
        return pa.RecordBatch.from_pylist([{"kind": kind, "bucket": bucket, "path": write_arrays(folder, "contexts", arrays), "sizes": [len(x) for x in arrays]}])

    def run(batches):
        keep_only("lm")
        key, held = None, []
        for batch in batches:
            for b, kind, ids, stats in zip(*(c.to_pylist() for c in batch.columns)):
                if (b, kind) != key and held:
                    yield finish(*key, held)
                    held = []
                key = b, kind
                held.append((unpack(ids, np.uint64), *(unpack(s, np.int64) for s in stats)))
        if held:
            yield finish(*key, held)

    return rows.mapInArrow(run, "kind string, bucket bigint, path string, sizes array<bigint>")


def merge_statistics(parts: DataFrame, folder: str, buckets: int, words: int) -> DataFrame:
    """(bucket, first, n, path, n1 .. n4): dense statistics of each range of word numbers, and the counts of
    continuation counts."""
    rows = parts.select("bucket", "kind", "ids", "stats").repartition("bucket").sortWithinPartitions("bucket")

    def finish(bucket, arrays, first, n):
        of = {**{f"n{k}": int((arrays[0] == k).sum()) for k in range(1, 5)}, "more": int((arrays[0] > 2).sum())}
        path = write_arrays(folder, "statistics", [a.astype("<i8") for a in arrays])
        return pa.RecordBatch.from_pylist([{"bucket": bucket, "first": first, "n": n, "path": path, **of}])

    def run(batches):
        keep_only("lm")
        bucket, arrays, first, n = None, None, 0, 0
        for batch in batches:
            for b, kind, ids, stats in zip(*(c.to_pylist() for c in batch.columns)):
                if b != bucket:
                    if arrays is not None:
                        yield finish(bucket, arrays, first, n)
                    # the numbers x with x * buckets // (words + 2) = b, b the last bucket or below
                    first = -(-b * (words + 2) // buckets)
                    n = (words + 2 if b == buckets - 1 else -(-(b + 1) * (words + 2) // buckets)) - first
                    bucket, arrays = b, [np.zeros(n, np.int64) for _ in range(5)]
                at = unpack(ids, np.int64) - first
                for k, s in enumerate(stats, 0 if kind == "word" else 1):
                    arrays[k][at] += unpack(s, np.int64)
        if arrays is not None:
            yield finish(bucket, arrays, first, n)

    return rows.mapInArrow(run, "bucket bigint, first bigint, n bigint, path string, n1 bigint, n2 bigint, n3 bigint, n4 bigint, more bigint")


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """D1, D2, D3+ of modified Kneser-Ney; fixed values where the counts of counts do not give them."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.05), k) for x, k in zip(d, (1.0, 2.0, 3.0)))


def train_kneser_ney(train: DataFrame, order: int = 2) -> dict:
    """The model's files and numbers. ``train``: one column of non-null texts; ``order``: words of an n-gram, 2 or more."""
    if order < 2:
        raise ValueError("the order is 2 or more")
    spark = train.sparkSession
    ship(spark)
    folder = shared_path(spark, "kneser-ney")
    counts = materialize(count_words(train), "lm-counts")
    segments, tokens = write_vocabulary(counts, folder)
    words = sum(s[1] for s in segments)
    if words + 2 >= LARGE:  # two word numbers share a key of 64 bits
        raise ValueError(f"{words} distinct words are too many for word numbers of 32 bits")
    buckets = max(1, -(-tokens // BUCKET))
    frequent = np.sort(np.array([r["h"] for r in counts.filter(F.col("c") > tokens / (4 * buckets)).select("h").collect()], np.int64))
    hot = np.append(Vocabulary(segments).numbers(frequent)[0], words + 1) if words else np.array([words + 1])
    with small_batches(spark):
        # the shuffle alone holds the packed n-grams: nothing reads them a second time
        merged = materialize(merge_ngrams(map_ngrams(train, segments, hot, buckets, order), folder, hot, buckets, words, order), "lm-shards")
        statistics = materialize(merge_statistics(merged.filter("kind in ('word', 'context')"), folder, buckets, words), "lm-statistics")
        contexts = materialize(merge_contexts(merged.filter("kind like 'hot%'"), folder), "lm-contexts") if order > 2 else None
    shards = merged.filter("kind = 'shard'").select("bucket", "path", "sizes", "seen").collect()
    longer = merged.filter("kind like 'cold%'").select("kind", "bucket", "path", "sizes").collect() + (contexts.collect() if contexts else [])
    ranges = statistics.collect()
    seen = np.array([r["seen"] for r in shards], np.int64).reshape(-1, order - 1, 4).sum(axis=0).tolist()
    of = [sum(r[f"n{k}"] for r in ranges) for k in range(1, 5)]
    return {"order": order, "tokens": tokens, "words": words, "buckets": buckets, "hot": hot, "segments": segments, "bigrams": sum(r["sizes"][0] for r in shards),
            "shards": tuple((r["bucket"], r["path"], tuple(r["sizes"])) for r in shards),
            "contexts": tuple((r["kind"], r["bucket"], r["path"], tuple(r["sizes"])) for r in longer),
            "ranges": tuple(sorted((r["first"], r["n"], r["path"]) for r in ranges)), "d1": discounts(*of), "d": tuple(discounts(*x) for x in seen),
            "seen": of, "more": sum(r["more"] for r in ranges)}


class KneserNey:
    """Scores batches of texts from a model's memory-mapped files."""

    def __init__(self, model: dict):
        self.model, self.vocabulary = model, worker_vocabulary(model["segments"])
        inner = model["order"] - 2
        self.shards = Mapped({b: (path, list(n), ["<u8", "<u8", "<u8", *["<u4"] * (2 * inner), "u1"]) for b, path, n in model["shards"]})
        self.contexts = Mapped({(kind, b): (path, list(n), CONTEXT) for kind, b, path, n in model["contexts"]})
        self.firsts = np.array([r[0] for r in model["ranges"]], np.int64)
        self.ranges = Mapped({k: (path, n, ["<i8"] * 5) for k, (_, n, path) in enumerate(model["ranges"])})
        d = np.array([0.0, *model["d1"]])
        total = model["bigrams"]
        self.unigram_discount, self.total = d, total
        n1, n2, *_ = model["seen"]
        kept = float(d @ [0, n1, n2, model["more"]])  # what the discounts take from all words
        self.uniform = kept / total / (model["words"] + 1) if total else 1.0

    def _statistics(self, ids: np.ndarray, columns: slice) -> list[np.ndarray]:
        """Statistics of sorted distinct word numbers; zero where there are none."""
        names = range(5)[columns]
        out = [np.zeros(len(ids), np.int64) for _ in names]
        part = np.searchsorted(self.firsts, ids, "right") - 1
        for k in np.unique(part[part >= 0]).tolist():
            b, e = np.searchsorted(part, [k, k + 1])
            arrays, at = self.ranges.get(k), ids[b:e] - self.firsts[k]
            fits = at < len(arrays[0])
            for o, c in zip(out, names):
                o[b:e][fits] = arrays[c][at[fits]]
        return out

    def _buckets(self, at: np.ndarray):
        """(bucket, places) of the places dealt to each bucket."""
        order = np.argsort(at, kind="stable")
        found, begins = np.unique(at[order], return_index=True)
        for b, begin, end in zip(found.tolist(), begins, [*begins[1:], len(at)]):
            yield b, order[begin:end]

    def _ngrams(self, levels: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(adjusted counts, whether they occur) of the n-grams of each level as :func:`combine` gives them."""
        m = self.model
        inner = m["order"] - 2
        counts = [np.zeros(len(k), np.int64) for k in levels]
        places = [np.full(len(k), -1, np.int64) for k in levels]
        at = deal(*halves(levels[0]), m["hot"], m["buckets"], m["words"])
        begins = [halves(levels[0])[0] == m["words"] + 1, *((k & LOW) == np.uint64(m["words"] + 1) for k in levels[1:])]
        for k, key in enumerate(levels):
            if k:
                parent = (key >> HALF).astype(np.int64)
                at = at[parent]
            for b, who in self._buckets(at):
                shard = self.shards.get(b)
                if shard is None:
                    continue
                pairs, many, often, *rest = shard
                starts, lefts, top = rest[:inner], rest[inner:2 * inner], rest[-1]
                if k == 0:
                    place = np.minimum(np.searchsorted(pairs, key[who]), len(pairs) - 1)
                    hit = pairs[place] == key[who]
                else:
                    who = who[places[k - 1][parent[who]] >= 0]
                    above = places[k - 1][parent[who]]
                    low, high = starts[k - 1][above].astype(np.int64), starts[k - 1][above + 1].astype(np.int64)
                    last, word = high - 1, (key[who] & LOW).astype(np.int64)
                    while (open_ := low < high).any():  # all ranges are halved at once
                        middle = (low + high) // 2
                        less = open_ & (lefts[k - 1][np.minimum(middle, last)] < word)
                        low, high = np.where(less, middle + 1, low), np.where(open_ & ~less, middle, high)
                    place = np.minimum(low, last)
                    hit = lefts[k - 1][place] == word
                who, place = who[hit], place[hit]
                places[k][who] = place
                leaf, c = place, None
                for s in starts[k:]:
                    c = s[leaf + 1].astype(np.int64) - s[leaf] if c is None else c
                    leaf = s[leaf].astype(np.int64)
                if c is None or begins[k][who].any():
                    raw = top[leaf].astype(np.int64)
                    large = raw == 255
                    raw[large] = often[np.searchsorted(many, leaf[large].astype(np.uint64))]
                    c = raw if c is None else np.where(begins[k][who], raw, c)
                counts[k][who] = c
        return counts, [p >= 0 for p in places]

    def _longer(self, k: int, keys: np.ndarray, v: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(4 statistics, whether kept) of contexts of the level k, given their last two words."""
        m = self.model
        out, found = np.zeros((4, len(keys)), np.int64), np.zeros(len(keys), bool)
        frequent = np.isin(v, m["hot"])
        for b, who in self._buckets(deal(v, u, m["hot"], m["buckets"], m["words"])):
            for kind, part in (("cold", who[~frequent[who]]), ("hot", who[frequent[who]])):
                held = self.contexts.get((f"{kind}{k + 2}", b))
                if held is None or not len(held[0]) or not len(part):
                    continue
                place = np.minimum(np.searchsorted(held[0], keys[part]), len(held[0]) - 1)
                hit = held[0][place] == keys[part]
                found[part[hit]] = True
                for o, a in zip(out, context_statistics(held, place[hit])):
                    o[part[hit]] = a
        return out, found

    def score(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base score, score) of each text."""
        m = self.model
        hashes, begins = token_hashes(texts)
        pairs, lefts, c = ngram_words(hashes, begins, self.vocabulary, m["order"])
        v, w = halves(pairs)
        n, starts = np.diff(begins), begins[:-1]
        if not m["tokens"]:
            return n, np.zeros(len(n), np.int64), np.zeros(len(n)), np.zeros(len(n))
        base = np.log10((c + 1) / (m["tokens"] + 1 * (m["words"] + 1)))
        ws, place = np.unique(w, return_inverse=True)
        cont = self._statistics(ws, slice(0, 1))[0]
        p1 = (np.maximum(cont - self.unigram_discount[np.minimum(cont, 3)], 0) / self.total + self.uniform)[place]
        levels, places = combine(pairs, lefts)
        counts, occurs = self._ngrams(levels)
        vs, place = np.unique(v, return_inverse=True)
        statistics = np.array(self._statistics(vs, slice(1, 5)))[:, place]
        p = p1
        position = np.arange(len(w)) - np.repeat(starts, n)
        key = v.astype(np.uint64)
        for k, d in enumerate(m["d"]):
            if k:
                # the context is the n-gram that ends before this token; a kept one occurs more than once
                key = key << HALF | lefts[0] if k == 1 else mixed(key, lefts[k - 1])
                keys, first, place = np.unique(key, return_index=True, return_inverse=True)
                statistics, kept = self._longer(k, keys, v[first], lefts[0][first].astype(np.int64))
                statistics, kept = statistics[:, place], kept[place]
                known = np.zeros(len(w), bool)
                known[1:] = occurs[k - 1][places[k - 1]][:-1]
                known &= position >= k
                once = known & ~kept
                statistics = np.where(known, statistics, 0)
                statistics[:2, once] = 1
            total, one, two, more = statistics
            seen = counts[k][places[k]]
            taken = np.maximum(seen - np.array([0.0, *d])[np.minimum(seen, 3)], 0)
            spare = np.where(total > 0, (d[0] * one + d[1] * two + d[2] * more) / np.maximum(total, 1), 1.0)
            p = np.where(total > 0, taken / np.maximum(total, 1), 0.0) + spare * p
        return n, np.add.reduceat(c > 0, starts, dtype=np.int64), np.add.reduceat(base, starts), np.add.reduceat(np.log10(p), starts)


_MODELS: dict[str, KneserNey] = {}
_CACHES["lm"] = lambda: (_MODELS.clear(), worker_vocabulary.cache_clear())


def worker_model(model: dict) -> KneserNey:
    key = model["key"]
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = KneserNey(model)
    return _MODELS[key]


def score_texts(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of every whole text."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast({**model, "key": uuid.uuid4().hex})  # names of files and a few numbers
    x = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))

    def run(batches):
        keep_only("lm")
        scorer = worker_model(sent.value)
        for batch in batches:
            for part in byte_slices(batch, 1, SLICE):
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, scorer.score(part.column(1)))], ["id", "n_tokens", "n_known", "base_score", "score"])

    return x.mapInArrow(run, f"id {x.schema['id'].dataType.simpleString()}, n_tokens bigint, n_known bigint, base_score double, score double")


def op6_language_model(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = lambda c: F.coalesce(F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))
    model = train_kneser_ney(docs.filter(~held("doc_id")).select(text_or_empty("text").alias("t")), ORDER)
    return score_texts(docs, model).select(F.col("id").alias("doc_id"), held("id").alias("held_out"), "n_tokens", "n_known",
                                           F.lit(model["tokens"]).cast("bigint").alias("train_tokens"), "base_score", "score")
