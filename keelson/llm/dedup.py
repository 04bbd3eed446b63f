"""Exact dedup by stateful streaming.

Each row is reduced to (digest of the normalised text, identifier, content locator). The reduced rows are streamed
through an aggregation keyed by digest whose state is kept in RocksDB without a watermark, so keys never expire. The
state holds, per digest, the largest identifier with its content locator and the number of rows. It is read back with
Spark's state reader. Then hits (digests seen more than once) are checked on their full texts: rows are fetched by
locator and grouped by digest *and* text; digests that stand for more than one text are decided by the texts alone.

Rows of a hot digest are combined before every shuffle. The content locator is the file and row number that the
Parquet reader gives; an input that has none is written to the shared folder first.

Defined results: a null text equals an empty one; of rows equal in identifier and text, the one with the largest
locator stays; null identifiers order lowest; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, shared_path, text_or_empty

#: The state store: RocksDB, without disk space set aside in advance by each of its many small instances.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Reduced rows (Parquet bytes) that one micro-batch takes.
BATCH_BYTES = 16 << 30


def sha256_digest(normalised: Column) -> Column:
    return F.sha2(normalised, 256)


def with_locator(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct column ``loc`` (file, row) naming each row's place in its Parquet files."""
    loc = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("loc")
    try:
        return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), loc)
    except AnalysisException:
        stored = materialize(docs, "dedup-input")
        return stored.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), loc)


@contextmanager
def state_conf(spark):
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stream_state(reduced: DataFrame, folder: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(digest, top(id, loc), group_size) of the rows (digest, id, loc) of ``folder``, read from the query's state."""
    spark = reduced.sparkSession
    checkpoint = shared_path(spark, "dedup-state")
    with state_conf(spark):
        rows = spark.readStream.schema(reduced.schema).option("maxBytesPerTrigger", batch_bytes).parquet(folder)
        state = rows.groupBy("digest").agg(F.max(F.struct("id", "loc")).alias("top"), F.count(F.lit(1)).alias("n"))
        query = (state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        if query.lastProgress is None:  # no batch ran: the source has no rows
            none = F.lit(False)
            return reduced.filter(none).select("digest", F.struct("id", "loc").alias("top"), F.lit(1).cast("bigint").alias("group_size"))
        held = spark.read.format("statestore").load(checkpoint)
        top, n = held.schema["value"].dataType.names
        return materialize(held.select(F.col("key.digest").alias("digest"), F.col(f"value.`{top}`").alias("top"),
                                       F.col(f"value.`{n}`").alias("group_size")), "dedup-groups")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                digest: Callable[[Column], Column] = sha256_digest, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per document: (id, loc, digest, keep_id, keep_loc, group_size, kept).

    ``digest`` may be any function of the normalised text; results stay exact when it collides."""
    return dedup_located(with_locator(docs), id_col, text_col, digest, batch_bytes)


def dedup_located(located: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  digest: Callable[[Column], Column] = sha256_digest, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """:func:`exact_dedup` of rows (doc, loc)."""
    spark = located.sparkSession
    text = ascii_lower(F.coalesce(F.col(f"doc.`{text_col}`"), F.lit("")))
    folder = shared_path(spark, "dedup-rows")
    located.select(digest(text).alias("digest"), F.col(f"doc.`{id_col}`").alias("id"), "loc").write.parquet(folder)
    reduced = spark.read.parquet(folder)
    labelled = reduced.join(stream_state(reduced, folder, batch_bytes), "digest")

    # full texts of the hits, fetched by locator; equal texts are combined before the second shuffle
    full = located.select("loc", text.alias("norm"))
    hits = labelled.filter("group_size > 1").select("loc", "digest", "id")
    held = hits.join(full, "loc").groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n"))
    mixed = materialize(held.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest"), "dedup-mixed")
    plain = labelled.select("id", "loc", "digest", F.col("top.id").alias("keep_id"), F.col("top.loc").alias("keep_loc"), "group_size")
    if not mixed.isEmpty():  # one digest, several texts: the texts decide
        texts = hits.join(mixed, "digest", "left_semi").join(full, "loc")
        groups = texts.groupBy("digest", "norm").agg(F.max(F.struct("id", "loc")).alias("top"), F.count(F.lit(1)).alias("group_size"))
        split = texts.join(groups, ["digest", "norm"]).select(
            "id", "loc", "digest", F.col("top.id").alias("keep_id"), F.col("top.loc").alias("keep_loc"), "group_size")
        plain = plain.join(mixed, "digest", "left_anti").select(split.columns).unionByName(split)
    return plain.withColumn("kept", F.col("loc") == F.col("keep_loc"))


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    out = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def stage_exact_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, with the input's columns."""
    located = with_locator(docs)
    kept = dedup_located(located).filter("kept").select("loc")
    return located.join(kept, "loc", "left_semi").select("doc.*")


OP3_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
