"""Typed CSV scans (S1-S3). Schemas are always declared, never inferred."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def wide_schema(key_cols: Sequence[str] = (), float_cols: Iterable[str] = (), string_cols: Iterable[str] = (),
                order: Sequence[str] | None = None, float_type: T.DataType = T.FloatType()) -> T.StructType:
    """Build a StructType from name lists: keys are long, floats 32-bit, strings.

    A name in ``string_cols`` overrides ``float_cols`` (a numbered column family can
    be declared float as a range, then a few members switched to string).
    ``order`` gives the file's column order; by default keys, floats, strings.
    """
    strings = list(dict.fromkeys(string_cols))
    floats = [c for c in dict.fromkeys(float_cols) if c not in set(strings)]
    types = {c: T.LongType() for c in key_cols}
    types.update({c: float_type for c in floats})
    types.update({c: T.StringType() for c in strings})
    names = list(order) if order is not None else list(key_cols) + floats + strings
    missing = [c for c in names if c not in types]
    if missing:
        raise ValueError(f"no type declared for {missing}")
    return T.StructType([T.StructField(c, types[c], True) for c in names])


def numbered(prefix: str, lo: int, hi: int, width: int = 0, sep: str = "") -> list[str]:
    """Column names ``prefix{sep}{i}`` for i in [lo, hi], zero-padded to ``width``."""
    return [f"{prefix}{sep}{str(i).zfill(width)}" for i in range(lo, hi + 1)]


def read_csv(spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str] | None = None,
             header: bool = True) -> DataFrame:
    """CSV with header and a declared schema; ``columns`` prunes (Catalyst pushes
    the projection into the scan, so unused columns are never parsed). A header
    whose names or order differ from the schema is an error, not a silent shift."""
    df = (spark.read.schema(schema).option("header", header).option("enforceSchema", not header)
          .option("mode", "FAILFAST").csv(path))
    return df.select(*columns) if columns else df


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path
