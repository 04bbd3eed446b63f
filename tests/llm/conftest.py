import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                       # names that the operators use inside
                       *[T.StructField(c, T.StringType()) for c in ("id", "t", "n", "key", "row", "digest", "loc", "doc", "size", "src", "host", "a", "b")]])

LONG = " ".join(f"w{i * 7919 % 1013}x{i}" for i in range(30_000))
BASE = " ".join(f"word{i}" for i in range(60))
ODD_ROWS = [
    (1, None, None, None, None), (2, "", "en", "s1", 0), (3, " \t\n ", "en", "s1", 4), (4, "one two", "en", "s1", 7), (5, "One Two", "en", None, 7),
    (6, BASE, "en", "s1", 1), (7, BASE, "en", "s2", 1), (7, BASE, "en", "s2", 1), (8, BASE.replace("word30", "other"), "en", "s2", 1),
    (9, LONG, "de", "s2", len(LONG)), (10, LONG + " tail", "de", "s3", 1), (11, "a b c d e f g h " * 10, "en", "s3", 1),
    (12, "ÄÖÜ ß İ Σας x\x1cy <|endoftext|> 中文 😀 é it's 12,3½", "xx", "s3", 1), (13, "password: hunter2secretvalue", "en", "", 1),
    (14, BASE.upper(), "en", "s1", 1), (None, "no id here " + BASE, "en", "s1", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with the operators' inner names."""
    return spark.createDataFrame([(*r, *["?"] * 13) for r in ODD_ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def small_rows(small):
    return [(r.doc_id, r.text, r.source) for r in small.collect()]
