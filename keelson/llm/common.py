"""Column expressions and storage helpers shared by the training-data operators.

A *word* is a maximal run of code points other than space and \\x09-\\x0D, a null text is an empty text. Only A-Z are
lower-cased. Intermediate tables are Parquet files in the shared folder named by ``spark.checkpoint.dir``, so they
survive lost executors; none of the helpers keeps data on a single machine.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: A lookup table up to this many bytes (measured, not estimated) is broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; every other code point stays (``lower`` would also change non-ASCII letters)."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """The words of a non-null text, in order; an empty array when there is none."""
    t = F.btrim(c, F.lit(SPACE))
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.split(t, GAP))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared scratch folder."""
    path = scratch_path(spark, f"llm/{name}-{uuid.uuid4().hex[:12]}")
    for paths in _RECORDERS:
        paths.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, keeps column pruning."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hinted(small: DataFrame, key: str) -> DataFrame:
    """``small`` with a broadcast hint if its measured size (rows, and bytes of ``key``) is within BROADCAST_BYTES."""
    rows, size = small.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(key).cast("string"))), F.lit(0))).first()
    width = 16 * len(small.columns)
    return F.broadcast(small) if rows * width + size <= BROADCAST_BYTES else small


def group_key(col: str) -> Column:
    """A non-null text key for a nullable column: null and text stay distinct."""
    return F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit(""))


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers."""
    ship_package(spark)


def byte_slices(batch, column: int, limit: int):
    """Slices of an Arrow batch whose text column holds up to ``limit`` bytes each (or one row)."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def hashed_words(texts):
    """(64-bit hashes of all words of an Arrow text column, A-Z lower-cased; begins of the rows' words, one more
    than rows). Arrow cuts and numbers the words; each distinct word is hashed once."""
    import numpy as np
    import pyarrow.compute as pc
    import xxhash

    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = lists.flatten().dictionary_encode()
    distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))
    codes = coded.indices.to_numpy()
    bounds = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    if "" in distinct:  # white space at an end of a text
        real = codes != distinct.index("")
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
        codes = codes[real]
    return hashes[codes], bounds


_RECORDERS: list[list[str]] = []


@contextmanager
def recorded(paths: list[str]):
    """Add to ``paths`` what :func:`shared_path` hands out inside the block."""
    _RECORDERS.append(paths)
    try:
        yield
    finally:
        _RECORDERS.pop()


def delete_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of the shared file system that no frame reads any more."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: What each operator keeps in a Python worker between tasks, and how to drop it.
_CACHES: dict = {}


def keep_only(owner: str) -> None:
    """Drop what other operators keep in this Python worker: Spark reuses workers from stage to stage, and their tables
    would add up."""
    for name, clear in _CACHES.items():
        if name != owner:
            clear()
