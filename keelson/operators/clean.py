"""Projection, casting, null handling."""

from __future__ import annotations

import datetime
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def drop_null_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(how="any", subset=list(subset) if subset else None)


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def select_ordered(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols)


def rename_positional(df: DataFrame, like: Sequence[str] | DataFrame) -> DataFrame:
    """Rename columns by position to the names of ``like`` (a frame or a name list)."""
    names = like.columns if isinstance(like, DataFrame) else list(like)
    if len(names) != len(df.columns):
        raise ValueError(f"{len(df.columns)} columns cannot take {len(names)} names")
    return df.toDF(*names)


def cast_columns(df: DataFrame, cols: Sequence[str], dtype: str = "float") -> DataFrame:
    """Cast the listed columns in one projection (float32 by default)."""
    cset = set(cols)
    return df.select(*[F.col(c).cast(dtype).alias(c) if c in cset else F.col(c) for c in df.columns])


def shape_report(df: DataFrame, split_col: str = "split") -> DataFrame:
    """Rows per split and the column count."""
    n_cols = len(df.columns)
    return df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(n_cols).cast("bigint"))


def fill_constant(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.fillna(dict(values))


def column_modes(df: DataFrame, cols: Sequence[str]) -> dict:
    """Most frequent non-null value per column, the smallest on ties. The columns are stacked, so one scan and one grouping
    count the values of all of them and no task holds a column's whole table of values; one row per column comes back."""
    from .encode import KEYS, _kind, _stack

    counts = _stack(df, cols).groupBy("feature", *KEYS).agg(F.count(F.lit(1)).alias("_count"))
    top = counts.groupBy("feature").agg(F.min(F.struct((-F.col("_count")).alias("_count"), *KEYS)).alias("top"))
    found = {r["feature"]: r["top"] for r in top.collect()}
    return {c: _plain(df, c, found[c][_kind(df, c)]) if c in found else None for c in cols}


def _plain(df: DataFrame, c: str, value):
    """A stacked value in the column's own type."""
    t = df.schema[c].dataType
    if isinstance(t, T.BooleanType):
        return bool(value)
    if isinstance(t, T.DateType):
        return datetime.date(1970, 1, 1) + datetime.timedelta(days=value)
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=value)
    return value


def fill_mode(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Nulls to the column's mode in ``fit_on`` (default: ``df`` itself)."""
    modes = column_modes(fit_on if fit_on is not None else df, cols)
    out = {c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)).alias(c) for c, v in modes.items() if v is not None}
    return df.select(*[out.get(c, F.col(c)) for c in df.columns])


def sentinel_to_null(c, sentinel=-1):
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(sentinel))
