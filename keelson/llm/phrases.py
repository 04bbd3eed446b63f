"""Phrase collocation mining over count streams in prefix and suffix order.

1. Words. Tasks cut whole texts into pieces and words and count them by language; the words get 64-bit numbers, dealt
   again with another seed should two of them ever get the same.
2. Phrases, one length after the other, up to ``max_words``. Only a phrase whose two ends one word shorter are frequent
   can be frequent itself, so tasks skip what a filter of the frequent shorter phrases' hashes rules out (a bit array of
   FILTER_BITS, however much is counted; what it lets pass wrongly is counted in vain and dropped). What a task sees is
   sorted and combined before the shuffle.
3. Streams. All frequent phrases of all lengths form one stream of number tuples, shorter ones before those that they
   begin. It is range-partitioned and sorted in suffix order (last word first), then in prefix order. A partition that
   begins inside a phrase's extensions gets copies of the shorter phrases that it continues. Each partition is then
   merged in lockstep: for every phrase the latest shorter entry before it is the count of its last (first) words, and
   the counts that follow are those of its extensions to the left (right). Nothing is looked up by a hash. The passes
   also hand the words' text along, so no text is joined either.
4. The lowest-scoring cut of each candidate in exact decimals; candidates whose extension is half as frequent go; the
   best of each language by levels of groups, each of which keeps no more than asked for.

The streams are partitioned by rows, so a word that begins a third of all phrases is spread over partitions like others.

Defined results: a null or empty text has no words; a null language is ``und`` and together with it; repeated rows count
each; ids are not used; a very long text is cut whole, in a batch of its own; equal scores go by count, then by text in
byte order; an empty table, or one without frequent phrases, gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _CACHES, byte_slices, hinted, keep_only, materialize, shared_path, ship
from .tokenfile import open_fs

MIN_COUNT, MAX_WORDS, TOP = 10, 3, 2000
#: A candidate is dropped if a longer one holds it at this share (percent) of its count or more.
COVER_PERCENT = 50
NO_LANG = "und"
#: Text bytes counted together; bits of the filter of frequent phrases (a power of two, 16 MB); phrases per partition.
SLICE, FILTER_BITS, PART_ROWS = 6 << 20, 1 << 27, 1 << 20
#: Groups that a level of the ranking puts together; rows of an Arrow batch of counts.
FAN, BATCH_ROWS = 64, 1 << 16
#: What a byte is: 0 of a word, 1 a space, 2 a break between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32


def cut_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """(words of all rows, each one's row, each one's piece): pieces are numbered through all rows."""
    texts = texts.cast(pa.large_string())
    n, offsets = len(texts), np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    bounds = offsets - offsets[0]
    kind = _KIND[raw]
    inside = kind == 0
    first = inside.copy()
    if len(raw):
        first[1:] &= ~inside[:-1]
        begins = bounds[:-1][bounds[:-1] < bounds[1:]]
        first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    row = np.searchsorted(bounds, starts, "right") - 1
    places = np.int32 if len(raw) < 1 << 31 else np.int64
    piece = np.cumsum(kind == 2, dtype=places)[starts] + row if len(starts) else np.zeros(0, np.int64)
    packed = np.cumsum(inside, dtype=places)
    ends = np.append(packed[starts] - 1, packed[-1] if len(raw) else 0).astype(np.int64)
    del packed
    data = _FOLD[raw[inside]]
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes()))
    return words.dictionary_encode(), row, piece


def word_numbers(words: list[str], lang: str, seed: int, bits: int = 64) -> np.ndarray:
    """The words' numbers of ``bits`` bits (fewer than 64 only to test what happens if two get the same)."""
    import xxhash

    start = xxhash.xxh64_intdigest(lang, seed)
    return np.fromiter((xxhash.xxh64_intdigest(w, start) for w in words), np.uint64, len(words)) >> np.uint64(64 - bits)


def _by_language(batch: pa.RecordBatch):
    """(language, texts) of a batch (text, lang), each language's rows together."""
    coded = batch.column(1).dictionary_encode()
    codes = coded.indices.to_numpy()
    for k, lang in enumerate(coded.dictionary.to_pylist()):
        yield lang, batch.column(0) if len(coded.dictionary) == 1 else batch.column(0).take(pa.array(np.flatnonzero(codes == k)))


def count_words(docs: DataFrame) -> DataFrame:
    """(text, lang) -> (lang, word, f)."""

    def run(batches):
        keep_only("phrases")
        for batch in batches:
            for part in byte_slices(batch, 0, SLICE):
                for lang, texts in _by_language(part):
                    words, _, _ = cut_words(texts)
                    n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), words.dictionary.cast(pa.string()), pa.array(n.astype(np.int64))], ["lang", "word", "f"])

    return docs.mapInArrow(run, "lang string, word string, f bigint").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def number_words(words: DataFrame, bits: int = 64) -> tuple[DataFrame, int]:
    """(lang, word, f) -> the same with the number ``w1``, different for different words, and the seed that gave it."""
    for seed in range(64):

        def run(batches, seed=seed):
            keep_only("phrases")
            for b in batches:
                out = np.zeros(b.num_rows, np.uint64)
                coded = b.column(0).dictionary_encode()
                for k, lang in enumerate(coded.dictionary.to_pylist()):
                    at = np.flatnonzero(coded.indices.to_numpy() == k)
                    out[at] = word_numbers(b.column(1).take(pa.array(at)).to_pylist(), lang, seed, bits)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out.view(np.int64))], ["lang", "word", "f", "w1"])

        out = materialize(words.mapInArrow(run, "lang string, word string, f bigint, w1 bigint"), "phrase-words")
        if out.groupBy("w1").count().filter("count > 1").isEmpty():
            return out, seed
    raise ValueError("no seed gives all words different numbers")


def phrase_hash(columns: list[np.ndarray]) -> np.ndarray:
    """A hash of number tuples, for the filter."""
    x = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        x = (x ^ c.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return x


def write_filter(phrases: DataFrame, words: int, bits: int = FILTER_BITS) -> str:
    """The path of the bit array of the phrases' hashes (two bits each), by blocks of 32768 bits."""

    def run(batches):
        keep_only("phrases")
        for b in batches:
            if b.num_rows:
                h = phrase_hash([c.to_numpy() for c in b.columns])
                at = np.concatenate([h % np.uint64(bits), (h >> np.uint64(32)) * np.uint64(0x9E3779B1) % np.uint64(bits)]).astype(np.int64)
                at = np.unique(at)
                yield pa.RecordBatch.from_arrays([pa.array(at >> 15), pa.array(at & 32767)], ["block", "bit"])

    path = shared_path(phrases.sparkSession, "phrase-filter")
    rows = phrases.select(*[f"w{i + 1}" for i in range(words)]).mapInArrow(run, "block bigint, bit bigint")
    rows.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")).write.parquet(path)
    return path


@lru_cache(maxsize=2)
def worker_filter(path: str, bits: int) -> np.ndarray:
    import pyarrow.dataset as ds
    from pyarrow.fs import FileSelector

    out = np.zeros(bits // 8, np.uint8)
    fs, place = open_fs(path)
    files = [f.path for f in fs.get_file_info(FileSelector(place)) if f.path.endswith(".parquet")]
    for b in ds.dataset(files, filesystem=fs, format="parquet").to_batches() if files else ():
        for block, held in zip(b.column("block").to_pylist(), b.column("bits").to_pylist()):
            out[block * 4096:block * 4096 + len(held)] = np.frombuffer(held, np.uint8)[:len(out) - block * 4096]
    return out


_CACHES["phrases"] = worker_filter.cache_clear


def in_filter(held: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    h, bits = phrase_hash(columns), np.uint64(8 * len(held))
    out = np.ones(len(h), bool)
    for at in (h % bits, (h >> np.uint64(32)) * np.uint64(0x9E3779B1) % bits):
        out &= held[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1
    return out


def count_phrases(docs: DataFrame, words: int, shorter: str, seed: int, filter_bits: int = FILTER_BITS, number_bits: int = 64) -> DataFrame:
    """(text, lang) -> (w1 .. wn, f) of the phrases of ``words`` words whose two ends may be frequent."""
    names = [f"w{i + 1}" for i in range(words)]

    def run(batches):
        keep_only("phrases")
        held = worker_filter(shorter, filter_bits)
        for batch in batches:
            for part in byte_slices(batch, 0, SLICE):
                for lang, texts in _by_language(part):
                    coded, _, piece = cut_words(texts)
                    code = coded.indices.to_numpy().astype(np.int64)
                    if len(code) < words:
                        continue
                    numbers = word_numbers(coded.dictionary.to_pylist(), lang, seed, number_bits)
                    # sub[i]: the phrase one word shorter that begins at word i (its row in ``rows``), -1 for none
                    at, sub, rows = np.arange(len(code)), code, numbers.reshape(-1, 1)
                    for k in range(2, words):
                        at = at[at + k - 1 < len(code)]
                        at = at[piece[at] == piece[at + k - 1]]
                        distinct, place = np.unique(sub[at] * len(numbers) + code[at + k - 1], return_inverse=True)
                        rows = np.column_stack([rows[distinct // len(numbers)], numbers[distinct % len(numbers)]])
                        sub = np.full(len(code), -1, np.int64)
                        sub[at] = place
                    # both ends may be frequent
                    good = np.append(in_filter(held, [np.ascontiguousarray(c) for c in rows.T]), False)[sub]
                    at = np.flatnonzero(good[:-1] & good[1:])
                    at = at[at + words - 1 < len(code)]
                    at = at[piece[at] == piece[at + words - 1]]
                    distinct, f = np.unique(sub[at] * len(numbers) + code[at + words - 1], return_counts=True)
                    del at, good, sub, code, piece
                    for k in range(0, len(distinct), BATCH_ROWS):
                        d = distinct[k:k + BATCH_ROWS]
                        columns = [*rows[d // len(numbers)].T, numbers[d % len(numbers)]]
                        yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns),
                                                          pa.array(f[k:k + BATCH_ROWS].astype(np.int64))], [*names, "f"])
                    del coded, numbers, rows, distinct, f
                    pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, ", ".join(f"{c} bigint" for c in (*names, "f"))).groupBy(*names).agg(F.sum("f").alias("f"))


def in_order(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The stream in the order of ``keys`` (shorter phrases first), cut into parts of about PART_ROWS: the rows with
    ``part``, and copies (``copied``) of the shorter phrases that a part's first row continues."""
    parts = math.ceil(rows.count() / PART_ROWS)
    order = [F.col(k).asc_nulls_first() for k in keys]
    dealt = rows.repartitionByRange(parts, *order) if parts > 1 else rows.coalesce(1)
    dealt = materialize(dealt.withColumn("part", F.spark_partition_id()).withColumn("copied", F.lit(False)), "phrase-stream")
    if parts <= 1:
        return dealt
    # null keys as a struct's null fields order first
    firsts = dealt.groupBy("part").agg(F.min(F.struct(*keys)).alias("at")).select(F.col("part").alias("to"), *[F.col(f"at.{k}").alias(f"at_{k}") for k in keys])
    out = dealt
    for n in range(1, len(keys)):
        # a row per part at most
        begun = F.broadcast(firsts.filter(F.col(f"at_{keys[n]}").isNotNull()))
        same = [F.col(k) == F.col(f"at_{k}") for k in keys[:n]] + [F.col(keys[n]).isNull(), F.col("part") < F.col("to")]
        out = out.unionByName(dealt.join(begun, same).select(*rows.columns, F.col("to").alias("part"), F.lit(True).alias("copied")))
    return out


def _latest(is_entry: np.ndarray) -> np.ndarray:
    """For each row the last row up to it that is an entry."""
    return np.maximum.accumulate(np.where(is_entry, np.arange(len(is_entry)), 0))


def merge_stream(table: pa.Table, keys: list[str], size: int) -> tuple[pa.Table, list[np.ndarray], np.ndarray]:
    """(the sorted part, for each length n the row of the phrase of the first n keys, largest count of an extension)."""
    columns = [pc.fill_null(table.column(k), 0).to_numpy() for k in keys]
    table = table.take(pa.array(_stream_order(table, columns)))
    n, f = table.column("n").to_numpy(), table.column("f").to_numpy()
    entries = [_latest(n == k) for k in range(1, size + 1)]
    longest = np.zeros(len(n), np.int64)
    for k in range(2, size + 1):
        at = np.flatnonzero(n == k)
        np.maximum.at(longest, entries[k - 2][at], f[at])
    return table, entries, longest


def _stream_order(table: pa.Table, columns: list[np.ndarray]) -> np.ndarray:
    """Sorted by the keys, absent ones first."""
    sorting = []
    n = table.column("n").to_numpy()
    for k in range(len(columns) - 1, -1, -1):
        sorting += [columns[k], n > k]
    return np.lexsort(sorting)


def suffix_pass(rows: DataFrame, size: int) -> DataFrame:
    """Adds to every phrase ``tails`` (counts of its last 1 .. n - 1 words), ``before`` (largest count of an extension to
    the left within its part) and ``end`` (the text of its last word)."""
    keys = [f"z{i + 1}" for i in range(size)]
    schema = ", ".join([*(f"w{i + 1} bigint" for i in range(size)), "n bigint, f bigint, lang string, word string, copied boolean",
                        "tails array<bigint>, before bigint, end string"])

    def run(_, table):
        table, entries, longest = merge_stream(table, keys, size)
        n, f = table.column("n").to_numpy(), table.column("f").to_numpy()
        tails = _ragged([f[e] for e in entries[:-1]], n - 1)
        end = table.column("word").combine_chunks().take(pa.array(entries[0]))
        names = [*(f"w{i + 1}" for i in range(size)), "n", "f", "lang", "word", "copied"]
        return pa.Table.from_arrays([*(table.column(c) for c in names), tails, pa.array(longest), end], [*names, "tails", "before", "end"])

    # z: the words from the last to the first
    held = F.array(*[F.col(f"w{j + 1}") for j in range(size)])
    turned = rows.withColumns({k: F.when(F.col("n") > i, F.element_at(held, (F.col("n") - i).cast("int"))) for i, k in enumerate(keys)})
    return in_order(turned, keys).groupBy("part").applyInArrow(run, schema)


def prefix_pass(rows: DataFrame, size: int) -> DataFrame:
    """Adds ``heads`` (counts of the first 1 .. n - 1 words), ``after`` (largest count of an extension to the right within
    its part), and the phrase's text and language; phrases of one word are left out."""
    keys = [f"w{i + 1}" for i in range(size)]
    schema = ", ".join([*(f"{k} bigint" for k in keys), "n bigint, f bigint, lang string, phrase string, copied boolean",
                        "tails array<bigint>, before bigint, heads array<bigint>, after bigint, part int"])

    def run(key, table):
        table, entries, longest = merge_stream(table, keys, size)
        n, f = table.column("n").to_numpy(), table.column("f").to_numpy()
        heads = _ragged([f[e] for e in entries[:-1]], n - 1)
        end, phrase = table.column("end").combine_chunks(), None
        for k in range(size):
            step = end.take(pa.array(entries[k]))
            phrase = step if phrase is None else pc.if_else(pa.array(n > k), pc.binary_join_element_wise(phrase, step, " "), phrase)
        lang = table.column("lang").combine_chunks().take(pa.array(entries[0]))
        names = [*keys, "n", "f"]
        out = pa.Table.from_arrays([*(table.column(c) for c in names), lang, phrase, table.column("copied"), table.column("tails"), table.column("before"),
                                    heads, pa.array(longest), pa.array([key[0].as_py()] * len(n), pa.int32())],
                                   [*names, "lang", "phrase", "copied", "tails", "before", "heads", "after", "part"])
        return out.filter(pa.array(n > 1))

    return in_order(rows, keys).groupBy("part").applyInArrow(run, schema)


def _ragged(columns: list[np.ndarray], lengths: np.ndarray) -> pa.Array:
    """Lists of the first ``lengths`` of the columns' values of each row."""
    both = np.column_stack(columns) if columns else np.zeros((len(lengths), 0), np.int64)
    keep = np.arange(both.shape[1]) < lengths[:, None]
    offsets = np.concatenate([[0], np.cumsum(np.minimum(lengths, both.shape[1]))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(both[keep].astype(np.int64)))


def _extended(rows: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Rows that are not copies, their extensions' largest count also over the parts that continue them."""
    copies = rows.filter("copied").groupBy(*keys).agg(F.max(column).alias("elsewhere"))  # a few rows per part at most
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    out = rows.filter("NOT copied").alias("a").join(F.broadcast(copies).alias("b"), same, "left")
    return out.select(*[F.col(f"a.{c}") for c in rows.columns if c not in (column, "copied")], F.greatest(F.col(f"a.{column}"), F.coalesce("elsewhere", F.lit(0))).alias(column))


def mine_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
                 top: int = TOP, cover_percent: int = COVER_PERCENT, filter_bits: int = FILTER_BITS, number_bits: int = 64) -> DataFrame:
    """The best phrases of each language: (lang, rank, phrase, a, l, r, n, score)."""
    spark = docs.sparkSession
    ship(spark)
    base = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col), F.lit(NO_LANG)).alias("lang"))
    words, seed = number_words(count_words(base), number_bits)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    columns = [f"w{i + 1}" for i in range(max_words)]
    absent = F.lit(None).cast("bigint")
    frequent = words.filter(F.col("f") >= min_count)
    stream = frequent.select("w1", *[absent.alias(c) for c in columns[1:]], F.lit(1).cast("bigint").alias("n"), "f", "lang", "word")
    shorter = frequent
    for k in range(2, max_words + 1):
        held = write_filter(shorter, k - 1, filter_bits)
        shorter = materialize(count_phrases(base, k, held, seed, filter_bits, number_bits).filter(F.col("f") >= min_count), "phrase-counts")
        none = F.lit(None).cast("string")
        stream = stream.unionByName(shorter.select(*columns[:k], *[absent.alias(c) for c in columns[k:]], F.lit(k).cast("bigint").alias("n"), "f",
                                                   none.alias("lang"), none.alias("word")))
    stream = materialize(stream, "phrase-all")
    suffixes = _extended(materialize(suffix_pass(stream, max_words), "phrase-suffixes"), "before", columns)
    found = _extended(materialize(prefix_pass(suffixes, max_words), "phrase-prefixes"), "after", columns)

    # cuts after k words: l = count of the first k, r = of the last n - k; exact in decimals, lowest score, then smallest k
    def cut(head, i):
        l, r = head, F.element_at("tails", (F.size("tails") - i).cast("int"))
        wide = lambda c: c.cast("decimal(19,0)")
        score = F.call_function("div", wide(F.col("f")) * wide(F.col("f")) * F.lit(1_000_000).cast("decimal(7,0)"), wide(l) * wide(r))
        return F.struct(score.cast("bigint").alias("score"), i.alias("i"), l.alias("l"), r.alias("r"))

    kept = found.filter(100 * F.greatest("before", "after") < cover_percent * F.col("f"))
    best = kept.withColumn("cut", F.array_min(F.transform("heads", cut)))
    best = best.select("lang", "phrase", F.col("f").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"), F.col("part").alias("g"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    groups = (best.agg(F.max("g")).first()[0] or 0) + 1
    while groups > 1:
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "g").orderBy(*order))).filter(F.col("rank") <= top).drop("rank")
        best = materialize(best.withColumn("g", F.floor(F.col("g") / FAN)), "phrase-best")
        groups = math.ceil(groups / FAN)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    return best.join(hinted(totals, "lang"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark, sf_dir: str) -> DataFrame:
    return mine_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, row_number() OVER () AS pid, piece FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM t)),
w AS (SELECT lang, pid, unnest(ws) AS a, generate_subscripts(ws, 1) AS i
      FROM (SELECT lang, pid, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p)),
g AS (SELECT lang, a, lead(a, 1) OVER (PARTITION BY pid ORDER BY i) AS b, lead(a, 2) OVER (PARTITION BY pid ORDER BY i) AS c FROM w),
f1 AS (SELECT lang, a, count(*) AS f FROM g GROUP BY lang, a),
f2 AS (SELECT lang, a, b, count(*) AS f FROM g WHERE b IS NOT NULL GROUP BY lang, a, b HAVING count(*) >= 10),
f3 AS (SELECT lang, a, b, c, count(*) AS f FROM g WHERE c IS NOT NULL GROUP BY lang, a, b, c HAVING count(*) >= 10),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
longer AS (SELECT lang, a, b, max(f) AS f FROM (SELECT lang, a, b, f FROM f3 UNION ALL SELECT lang, b, c, f FROM f3) GROUP BY lang, a, b),
s2 AS (SELECT x.lang, x.a || ' ' || x.b AS phrase, x.f AS a, l.f AS l, r.f AS r, (1000000::HUGEINT * x.f * x.f) // (l.f::HUGEINT * r.f) AS score
       FROM f2 x JOIN f1 l ON l.lang = x.lang AND l.a = x.a JOIN f1 r ON r.lang = x.lang AND r.a = x.b
       LEFT JOIN longer o ON o.lang = x.lang AND o.a = x.a AND o.b = x.b WHERE coalesce(100 * o.f < 50 * x.f, true)),
k3 AS (SELECT x.lang, x.a || ' ' || x.b || ' ' || x.c AS phrase, x.f, l1.f AS l1, r1.f AS r1, l2.f AS l2, r2.f AS r2,
              (1000000::HUGEINT * x.f * x.f) // (l1.f::HUGEINT * r1.f) AS c1, (1000000::HUGEINT * x.f * x.f) // (l2.f::HUGEINT * r2.f) AS c2
       FROM f3 x JOIN f1 l1 ON l1.lang = x.lang AND l1.a = x.a JOIN f2 r1 ON r1.lang = x.lang AND r1.a = x.b AND r1.b = x.c
       JOIN f2 l2 ON l2.lang = x.lang AND l2.a = x.a AND l2.b = x.b JOIN f1 r2 ON r2.lang = x.lang AND r2.a = x.c),
s3 AS (SELECT lang, phrase, f AS a, CASE WHEN c1 <= c2 THEN l1 ELSE l2 END AS l, CASE WHEN c1 <= c2 THEN r1 ELSE r2 END AS r, least(c1, c2) AS score FROM k3),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM (SELECT * FROM s2 UNION ALL SELECT * FROM s3))
SELECT q.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM q JOIN n ON n.lang = q.lang WHERE rank <= 2000
"""
