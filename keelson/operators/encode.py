"""Encoders (E1-E3, A2-A4, F3).

Code and frequency tables for many columns are computed in ONE pass: the
columns are stacked into (feature, value) pairs, so a single shuffle serves all
of them, instead of a scan and a shuffle per column. Tables are applied back by
equi-joins that AQE turns into broadcast joins when the table is small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from . import joins, ranking

#: Columns of a stacked value, one per kind, so no value passes through another type: text, whole numbers (and booleans,
#: days of dates, microseconds of timestamps), decimals, floating point.
KEYS = ("s", "i", "n", "d")
_TYPES = {"s": "string", "i": "bigint", "n": "decimal(38,18)", "d": "double"}


def _kind(df: DataFrame, c: str) -> str:
    t = df.schema[c].dataType
    if isinstance(t, T.StringType):
        return "s"
    if isinstance(t, (T.IntegralType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "i"
    if isinstance(t, T.DecimalType):
        return "i" if t.scale == 0 and t.precision <= 18 else "n"
    if isinstance(t, T.FractionalType):
        return "d"
    raise TypeError(f"column {c} of type {t.simpleString()} cannot be encoded")


def _value(df: DataFrame, c: str) -> Column:
    """The column's value in the type of its kind."""
    t = df.schema[c].dataType
    if isinstance(t, T.DateType):
        return F.unix_date(c).cast("bigint")
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(c).cast("timestamp"))
    return F.col(c).cast(_TYPES[_kind(df, c)])


def _stack(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, s, i, n, d) rows, one per input row and non-null value."""
    structs = []
    for c in cols:
        kind = _kind(df, c)
        values = [(_value(df, c) if k == kind else F.lit(None).cast(_TYPES[k])).alias(k) for k in KEYS]
        structs.append(F.struct(F.lit(c).alias("feature"), *values))
    rows = df.select(F.explode(F.array(*structs)).alias("_p")).select("_p.*")
    return rows.where("s IS NOT NULL OR i IS NOT NULL OR n IS NOT NULL OR d IS NOT NULL")


def fit_label_codes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Code table (feature, s, i, n, d, code): 0-based codes of the non-null values of each
    column in sorted value order (E1).

    One scan and one shuffle find the distinct (feature, value) pairs of all columns (partial aggregation first, so a
    hot value is combined map-side); range partitions with offsets rank them, so no task holds a feature's whole value
    set. The table is materialised (it is the fitted state) and then joined to every column it encodes."""
    return cut_lineage(ranking.ranged_codes(_stack(df, cols).distinct(), ["feature"], list(KEYS)))


def _broadcastable(table: DataFrame, cols: Sequence[str]) -> set:
    """Features whose part of a fitted table is within the broadcast bound, measured in one job."""
    rows = table.where(F.col("feature").isin(list(cols))).groupBy("feature").agg(joins.measured_bytes(table).alias("n")).collect()
    return {r["feature"] for r in rows if r["n"] <= joins.BROADCAST_MAX_BYTES}


def _attach(df: DataFrame, table: DataFrame, c: str, value: str, small: set) -> DataFrame:
    """``df`` with the fitted ``value`` of column ``c`` as ``_v_{c}`` (null where there is none)."""
    t = table.where(F.col("feature") == F.lit(c)).select(F.col(_kind(df, c)).alias(f"_k_{c}"), F.col(value).alias(f"_v_{c}"))
    t = F.broadcast(t) if c in small else t
    return df.join(t, _value(df, c) == F.col(f"_k_{c}"), "left").drop(f"_k_{c}")


def apply_label_codes(df: DataFrame, codes: DataFrame, cols: Sequence[str], suffix: str = "",
                      missing: int = -1) -> DataFrame:
    """Replace (or add ``{c}{suffix}``) codes; null and unseen values get ``missing``."""
    out = df
    small = _broadcastable(codes, cols)
    for c in cols:
        out = _attach(out, codes, c, "code", small)
        out = out.withColumn(f"{c}{suffix}", F.coalesce(F.col(f"_v_{c}"), F.lit(missing)).cast("int")).drop(f"_v_{c}")
    return out


def label_encode(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None, suffix: str = "") -> DataFrame:
    """Fit on ``fit_on`` (default: ``df`` itself, e.g. train and test together) and apply."""
    codes = fit_label_codes(fit_on if fit_on is not None else df, cols)
    return apply_label_codes(df, codes, cols, suffix)


def combine_columns(c1: str, c2: str, sep: str = "_"):
    """Two columns as text joined by ``sep``; null becomes the text 'nan' (not skipped)."""
    return F.concat(F.coalesce(F.col(c1).cast("string"), F.lit("nan")), F.lit(sep),
                    F.coalesce(F.col(c2).cast("string"), F.lit("nan")))


def combine_encode(df: DataFrame, c1: str, c2: str, fit_on: DataFrame | None = None) -> DataFrame:
    """``{c1}_{c2}`` text column, label-encoded."""
    name = f"{c1}_{c2}"
    df = df.withColumn(name, combine_columns(c1, c2))
    fit = fit_on.withColumn(name, combine_columns(c1, c2)) if fit_on is not None else df
    return label_encode(df, [name], fit_on=fit)


def frequency_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, s, i, n, d, freq): share of the column's non-null rows holding the value.
    One pass for all columns with map-side partial counts; per-feature totals are a
    group-by (one row per column), not a window over a feature's whole value set.
    Materialised once, then joined to every column it encodes."""
    counts = _stack(df, cols).groupBy("feature", *KEYS).agg(F.count(F.lit(1)).alias("_count"))
    counts = cut_lineage(counts)
    totals = counts.groupBy("feature").agg(F.sum("_count").alias("_total"))   # one row per column
    t = counts.join(F.broadcast(totals), "feature").withColumn("freq", F.col("_count") / F.col("_total"))
    return t.drop("_count", "_total")


def freq_encode(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None,
                sentinel: float = -1) -> DataFrame:
    """A2: ``{c}_FE`` = frequency of the value; null stays null. The sentinel is a number: in number columns it maps to
    itself, a text that looks like it has a frequency like any other."""
    table = frequency_table(fit_on if fit_on is not None else df, cols)
    out = df
    small = _broadcastable(table, cols)
    for c in cols:
        number = _kind(df, c) != "s" and not isinstance(df.schema[c].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
        is_sentinel = F.coalesce(_value(df, c) == F.lit(sentinel), F.lit(False)) if number else F.lit(False)
        out = _attach(out, table, c, "freq", small)
        out = out.withColumn(f"{c}_FE", F.when(is_sentinel, F.lit(float(sentinel))).otherwise(F.col(f"_v_{c}"))).drop(f"_v_{c}")
    return out


def group_stat_encode(df: DataFrame, main_columns: Sequence[str], uids: Sequence[str],
                      aggregations: Sequence[str] = ("mean",), fit_on: DataFrame | None = None,
                      fillna: bool = True, usena: bool = False, sentinel: float = -1) -> DataFrame:
    """A3: per uid, mean / sample std of each main column, mapped back as
    ``{main}_{uid}_{agg}``. ``usena`` treats the sentinel as missing before
    aggregating; ``fillna`` turns a null result into the sentinel.

    All main columns and aggregates of one uid are ONE ``groupBy`` (partial
    aggregation on the map side, so a hot uid is combined before the shuffle).
    """
    funcs = {"mean": F.avg, "std": F.stddev_samp}
    fit = fit_on if fit_on is not None else df
    out = df
    for uid in uids:
        aggs = []
        for m in main_columns:
            src = F.nullif(F.col(m), F.lit(sentinel)) if usena else F.col(m)
            for a in aggregations:
                aggs.append(funcs[a](src.cast("double")).alias(f"{m}_{uid}_{a}"))
        stats = joins.sized_broadcast(cut_lineage(fit.groupBy(uid).agg(*aggs)))
        out = out.join(stats, uid, "left")
        if fillna:
            names = [f"{m}_{uid}_{a}" for m in main_columns for a in aggregations]
            out = out.fillna(float(sentinel), subset=names)
    return out


def group_nunique_encode(df: DataFrame, main_columns: Sequence[str], uids: Sequence[str],
                         fit_on: DataFrame | None = None) -> DataFrame:
    """A4: distinct count of each main column per uid (nulls not counted), named ``{uid}_{main}_ct`` (uid first)."""
    fit = fit_on if fit_on is not None else df
    out = df
    for uid in uids:
        stats = fit.groupBy(uid).agg(*[F.count_distinct(m).alias(f"{uid}_{m}_ct") for m in main_columns])
        out = out.join(joins.sized_broadcast(cut_lineage(stats)), uid, "left")
    return out


def one_hot_categories(train: DataFrame, col: str) -> list:
    """Sorted distinct non-null categories: the names of the columns to make."""
    return [r[0] for r in train.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col).collect()]


def one_hot(df: DataFrame, col: str, categories: Sequence, prefix: str | None = None, drop: bool = True) -> DataFrame:
    """One 0/1 column per category, ``{prefix}_{value}``; null or unseen gives all zeros."""
    prefix = prefix or col
    cols = [F.col(col).eqNullSafe(F.lit(v)).cast("int").alias(f"{prefix}_{v}") for v in categories]
    out = df.select("*", *cols)
    return out.drop(col) if drop else out
