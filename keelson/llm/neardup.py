"""Near-duplicates: minhash with tensored banding, links confirmed on full shingle sets.

1. Sketch: per text, the set of 64-bit hashes of its 5-word shingles, a digest of the set, and two collections of M
   short hashes, each made of K minhashes. Texts with equal sets form a class; the least id stands for it.
2. Tensored banding: the M * M table keys of a class are the pairs of one hash of either collection, so M * M tables of
   2 K minhashes need only 2 M K of them. A pair of similarity s shares no key with probability at most
   2 (1 - s^K)^M: 1e-4 at s = 0.75 with K = 2, M = 12.
3. Stars: in each bucket the first member by a global priority is the centre and every other member gives one (centre,
   member) row: never pairs of members. Rows are dealt by key and sorted; of the few buckets that hold a notable share of
   all rows the centres are found by a partial minimum and joined back by a broadcast, so no task gets such a bucket. Since priorities are global, a group of copies
   has few centres. Two classes that share a bucket share its centre.
4. Sets of the classes in stars are written to a store in the shared folder, and rows carry their places in it. Each
   star row is confirmed exactly.
5. Members not linked to their centre are compared with all members of the same centre: in blocks, hashed to a bounded
   size, inside a task, by an inverted index over the block's shingles. Blocks emit spanning links only. Members that
   are linked to the centre are in its component already. Sizes and the distances to the centre prune (triangle
   inequality), which loses no link.
6. Components of the links; the component of a text is that of its class.

No group is cut off, sampled or collected: a large bucket gives more star rows and more blocks.

Defined results: a text without words (or null) has an empty set, links with nothing and is its own component; one of
fewer than five words has its whole sequence as its only shingle; repeated rows are in the same class; a row without id
takes no part and has no component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import heavy_keys, hot_key_join
from .common import byte_slices, hashed_words, keep_only, materialize, shared_path, ship, text_or_empty
from .components import components
from .tokenfile import open_fs

SHINGLE = 5
#: Link: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Hashes in each of the two collections, minhashes in each hash.
M, K = 12, 2
#: Members, and members not linked to the centre, in a block.
BLOCK, QUERY_BLOCK = 2048, 512
#: Text bytes that are sketched together, and sets (bytes) that a worker keeps from the store.
SKETCH_BYTES, KEPT_BYTES = 2 << 20, 48 << 20
#: A bucket with more than this share of all rows is not sorted in one task.
BUCKET_SHARE = 1 / 2000
_ODD = np.array([int.from_bytes(hashlib.sha256(f"shingle {i}".encode()).digest()[:8], "little") | 1 for i in range(SHINGLE + 1)], np.uint64)
_MIN = np.array([int.from_bytes(hashlib.sha256(f"minhash {i}".encode()).digest()[:8], "little") | 1 for i in range(2 * M * K)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All shingle hashes of the texts, repeats included, and the begins of each text's."""
    w, at = hashed_words(texts)
    n = np.diff(at)
    full = np.zeros(max(0, len(w) - SHINGLE + 1), np.uint64)
    for i in range(SHINGLE):
        full += w[i:len(w) - SHINGLE + 1 + i] * _ODD[i]
    full = mix(full)
    sizes = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    begins = np.concatenate([[0], np.cumsum(sizes)])
    out = full[np.repeat(at[:-1] - begins[:-1], sizes).clip(0) + np.arange(begins[-1])] if len(full) and (n >= SHINGLE).all() else None
    if out is None:
        out = np.zeros(begins[-1], np.uint64)
        for i in np.flatnonzero(sizes):
            if n[i] >= SHINGLE:
                out[begins[i]:begins[i + 1]] = full[at[i]:at[i] + sizes[i]]
            else:  # the whole sequence, with its length
                length = np.array([n[i]], np.uint64) * _ODD[SHINGLE]
                out[begins[i]] = mix((w[at[i]:at[i + 1]] * _ODD[:n[i]]).sum(dtype=np.uint64, keepdims=True) + length)[0]
    return out, begins


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, digest, a, b): size and digest of the shingle set, and the two collections of M hashes."""
    ship(docs.sparkSession)
    x = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))

    def run(batches):
        keep_only("neardup")
        for batch in batches:
            for part in byte_slices(batch, 1, SKETCH_BYTES):
                s, begins = shingles(part.column(1))
                rows, some = part.num_rows, np.flatnonzero(np.diff(begins))
                n, digests = np.zeros(rows, np.int64), [None] * rows
                for i in some:
                    u = np.unique(s[begins[i]:begins[i + 1]])
                    n[i], digests[i] = len(u), xxhash.xxh3_128_digest(u.tobytes())
                hashes = np.zeros((rows, 2 * M), np.uint64)
                for j in range(2 * M):
                    for k in range(K):
                        h = s * _MIN[j * K + k]
                        h ^= h >> np.uint64(32)
                        if len(some):
                            hashes[some, j] = mix(hashes[some, j] * _ODD[0] + np.minimum.reduceat(h, begins[some]))
                sides = [pa.ListArray.from_arrays(pa.array(np.arange(0, rows * M + 1, M, np.int32)), pa.array(hashes[:, c].reshape(-1).view(np.int64)))
                         for c in (slice(0, M), slice(M, 2 * M))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(digests, pa.binary()), *sides], ["id", "n", "digest", "a", "b"])

    return x.mapInArrow(run, f"id {x.schema['id'].dataType.simpleString()}, n bigint, digest binary, a array<bigint>, b array<bigint>")


def stars(classes: DataFrame) -> DataFrame:
    """(c, x): each bucket's centre with each of its other members, distinct. ``classes``: (id, a, b).

    The centre is the member of least (priority, id). Buckets that hold more than BUCKET_SHARE of all rows are found by a
    bounded sketch; their centres come from a partially aggregated minimum and are joined back by a broadcast (there are
    at most 1 / BUCKET_SHARE), so their members stay where they are. All others are sorted by key."""
    keys = F.flatten(F.transform("a", lambda a: F.transform(F.col("b"), lambda b: F.xxhash64(a, b))))
    rows = classes.select("id", F.explode(keys).alias("key")).withColumn("priority", F.xxhash64("id"))
    large = heavy_keys(rows, "key", BUCKET_SHARE)
    if large:
        named = F.broadcast(classes.sparkSession.createDataFrame([(k,) for k in large], "key bigint"))
        hot = rows.join(named, "key")
        centres = hot.groupBy("key").agg(F.min(F.struct("priority", "id")).alias("m")).select("key", F.col("m.id").alias("c"))
        spread = hot.join(F.broadcast(centres), "key").filter("c <> id").select("c", F.col("id").alias("x"))
        rows = rows.join(named, "key", "left_anti")
    rows = rows.repartition("key").sortWithinPartitions("key", "priority", "id").select("key", "id")

    def run(batches):
        keep_only("neardup")
        last_key, centre = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            first = np.concatenate([[last_key is None or key[0] != last_key], key[1:] != key[:-1]])
            where = np.where(first, np.arange(len(key)), -1)
            where = np.maximum.accumulate(where)
            centres = np.where(where >= 0, ids[where], 0 if centre is None else centre)
            pick = ~first & (centres != ids)
            last_key, centre = key[-1], centres[-1]
            if pick.any():
                pairs = np.unique(np.stack([centres[pick], ids[pick]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["c", "x"])

    pairs = rows.mapInArrow(run, "c bigint, x bigint")
    return (pairs.unionByName(spread) if large else pairs).distinct()


def write_sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """Write the shingle sets of the documents in ``wanted`` (id) to the shared folder: (id, path, at, n) of each."""
    spark = docs.sparkSession
    ship(spark)
    folder = shared_path(spark, "shingle-sets")
    x = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t")).join(
        wanted.hint("merge"), "id", "left_semi")  # the same plan at every size

    def run(batches):
        keep_only("neardup")
        out, path, at, seen = None, "", 0, set()
        for batch in batches:
            for part in byte_slices(batch, 1, SKETCH_BYTES):
                if out is None:
                    path = f"{folder}/sets-{uuid.uuid4().hex}.bin"
                    fs, place = open_fs(path)
                    fs.create_dir(os.path.dirname(place), recursive=True)
                    out = fs.open_output_stream(place)
                s, begins = shingles(part.column(1))
                rows = []
                for i, doc_id in enumerate(part.column(0).to_pylist()):
                    if doc_id in seen or begins[i] == begins[i + 1]:
                        continue  # a repeated row
                    seen.add(doc_id)
                    u = np.unique(s[begins[i]:begins[i + 1]])
                    out.write(u.astype("<u8").tobytes())
                    rows.append({"id": doc_id, "path": path, "at": at, "n": len(u)})
                    at += 8 * len(u)
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema([("id", pa.int64()), ("path", pa.string()), ("at", pa.int64()), ("n", pa.int64())]))
        if out is not None:
            out.close()

    return materialize(x.mapInArrow(run, "id bigint, path string, at bigint, n bigint"), "set-places")


class SetStore:
    """Reads sets by place; keeps the last ones read, up to KEPT_BYTES."""

    def __init__(self):
        self.files, self.kept, self.size = {}, {}, 0

    def get(self, path: str, at: int, n: int) -> np.ndarray:
        found = self.kept.pop((path, at), None)
        if found is None:
            if path not in self.files:
                fs, place = open_fs(path)
                self.files[path] = fs.open_input_file(place)
            found = np.frombuffer(self.files[path].read_at(8 * n, at), "<u8")
            self.size += 8 * n
            while self.size > KEPT_BYTES and self.kept:
                self.size -= 8 * len(self.kept.pop(next(iter(self.kept))))
        self.kept[path, at] = found
        return found


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Number of common elements of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    place = np.searchsorted(b, a)
    place[place == len(b)] = 0
    return int((b[place] == a).sum()) if len(b) else 0


def is_link(shared, n, m):
    return 100 * shared >= PERCENT * (n + m - shared)


def confirm_stars(star: DataFrame, places: DataFrame) -> DataFrame:
    """(c, x, places, shared) of each star row, from full sets."""
    c = places.select(*[F.col(k).alias(f"c_{k}") for k in places.columns])
    x = places.select(*[F.col(k).alias(f"x_{k}") for k in places.columns])
    rows = hot_key_join(star, c, "c", "c_id", how="inner")  # a centre may have a third of all documents
    rows = rows.join(x, F.col("x") == F.col("x_id")).select(*c.columns, *x.columns)
    rows = rows.repartition("x_path", "x_at").sortWithinPartitions("c_path", "c_at", "x_path", "x_at")
    schema = rows.schema.simpleString()[7:-1].replace(":", " ") + ", shared bigint"

    def run(batches):
        keep_only("neardup")
        store = SetStore()
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            shared = [_shared(store.get(cp, ca, cn), store.get(xp, xa, xn)) for _, cp, ca, cn, _, xp, xa, xn in zip(*cols)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared, pa.int64())], [*batch.schema.names, "shared"])

    return rows.mapInArrow(run, schema)


def _find(parent: dict, x: int) -> int:
    while parent.setdefault(x, x) != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def block_links(members: list, queries: list, store: SetStore) -> list[tuple[int, int]]:
    """Spanning links between ``queries`` and ``members``: both (id, path, at, n, distance to the centre, linked).

    Members that are linked to the centre count as connected. Exact: counts shared elements by an inverted index."""
    sets = [store.get(*m[1:4]) for m in members]
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    away = np.array([m[4] for m in members])
    parent: dict = {}
    for m in members:  # those linked to the centre are one group, named by None's stand-in
        if m[5]:
            parent[m[0]] = -1
    parent[-1] = -1
    out = []
    for doc, path, at, n, distance, _ in queries:
        s = store.get(path, at, n)
        lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
        count = hi - lo
        ends = np.cumsum(count)
        hits = owner[np.repeat(lo - (ends - count), count) + np.arange(ends[-1])]
        shared = np.bincount(hits, minlength=len(sets))
        # |d(x, c) - d(y, c)| > 1 - s means no link; it only saves the loop below
        near = is_link(shared, n, sizes) & (np.abs(away - distance) <= 1 - PERCENT / 100 + 1e-9)
        for j in np.flatnonzero(near):
            other = members[j][0]
            a, b = _find(parent, doc), _find(parent, other)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((min(doc, other), max(doc, other)))
    return out


def block_members(star: DataFrame) -> DataFrame:
    """Links between members of the same centre, from blocks of bounded size: (a, b)."""
    distance = 1 - F.col("shared") / (F.col("c_n") + F.col("x_n") - F.col("shared"))
    rows = star.select("c_id", F.struct(F.col("x_id").alias("id"), F.col("x_path").alias("path"), F.col("x_at").alias("at"), F.col("x_n").alias("n"),
                                        distance.alias("distance"), F.col("linked").alias("linked")).alias("m"))
    groups = star.groupBy("c_id").agg(F.count(F.lit(1)).alias("members"), F.sum((~F.col("linked")).cast("int")).alias("open"))
    groups = groups.filter("open > 0 AND members > 1").select(
        "c_id", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("open") / QUERY_BLOCK).cast("int").alias("query_blocks"))
    rows = hot_key_join(rows, materialize(groups, "star-groups"), "c_id", how="inner")
    place = F.xxhash64("m.id")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = rows.withColumn("block", F.pmod(place, "blocks").cast("int")).withColumn("query_block", every("query_blocks"))
    asked = rows.filter("NOT m.linked").withColumn("query_block", F.pmod(place, "query_blocks").cast("int")).withColumn("block", every("blocks"))
    both = held.select("c_id", "block", "query_block", "m", F.lit(False).alias("asks")).unionByName(
        asked.select("c_id", "block", "query_block", "m", F.lit(True).alias("asks")))
    # dealt by block, not by centre: a large group spreads over the tasks
    units = both.repartition("c_id", "block", "query_block").groupBy("c_id", "block", "query_block").agg(
        F.collect_list(F.when(~F.col("asks"), F.col("m"))).alias("members"), F.collect_list(F.when(F.col("asks"), F.col("m"))).alias("queries"))
    units = units.select("members", "queries").filter("size(members) > 0 AND size(queries) > 0")

    def run(batches):
        keep_only("neardup")
        store = SetStore()
        for batch in batches:
            for members, queries in zip(batch.column(0), batch.column(1)):
                rows = [[tuple(m.values()) for m in side.as_py()] for side in (members, queries)]
                links = block_links(*rows, store)
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])

    return units.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, n_shingles, component, kept)."""
    sketched = materialize(sketch(docs, id_col, text_col), "sketches")
    some = sketched.filter("n > 0 AND id IS NOT NULL")
    classes = some.groupBy(F.hex("digest").alias("d")).agg(F.min("id").alias("class"))
    digest = F.when(F.col("n") > 0, F.hex("digest")).alias("d")  # null without words: not joined, nor sent to one task
    member = materialize(hot_key_join(sketched.select("id", "n", digest), classes, "d"), "classes")
    heads = member.filter("id = class AND n > 0").select("id").distinct()
    star = materialize(stars(sketched.join(heads, "id", "left_semi").dropDuplicates(["id"]).select("id", "a", "b")), "stars")
    wanted = star.select(F.col("c").alias("id")).unionByName(star.select(F.col("x").alias("id"))).distinct()
    places = write_sets(docs, id_col, text_col, wanted)
    confirmed = confirm_stars(star, places)
    confirmed = materialize(confirmed.withColumn("linked", is_link(F.col("shared"), F.col("c_n"), F.col("x_n"))), "star-links")
    found = confirmed.filter("linked").select(F.col("c_id").alias("a"), F.col("x_id").alias("b"))
    links = found.unionByName(block_members(confirmed))
    reached = components(links)
    out = member.join(reached.select(F.col("id").alias("class"), "component"), "class", "left")
    component = F.coalesce("component", "class", "id")
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component")).withColumn(
        "kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True)))


def op9_near_duplicates(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


def stage_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, with the input's columns."""
    dropped = near_duplicates(docs).filter("NOT kept").select(F.col("id").alias("doc_id"))
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                             ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g
  FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_have >= 75 * (x.n + y.n - both_have)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, least(a, min(b)) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id,
       coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id
"""
