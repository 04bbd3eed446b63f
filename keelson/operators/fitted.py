"""Mergeable fitted state (A2, A3, A5-A7): fits over train and test together, and over rows that come later, without
reading rows twice.

A moments state holds, per feature (and per uid for group statistics), the count, mean, sum of squared deviations, minimum
of the non-null values; two states merge by the pairwise rule, so nothing cancels. A counts state holds how often each
value occurs. Both are tables of the fitted size, combined map-side when they are built."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import encode, joins, scale

STATE = ("n", "mean", "m2", "least")


def _stacked(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (), missing: float | None = None) -> DataFrame:
    value = lambda c: F.nullif(F.col(c).cast("double"), F.lit(float(missing))) if missing is not None else F.col(c).cast("double")
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), value(c).alias("v")) for c in cols])
    rows = df.select(*keep, F.explode(pairs).alias("_p"))
    return rows.select(*rows.columns[:-1], "_p.*").where("v IS NOT NULL")


def _moments(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    n = F.count(F.lit(1))
    return rows.groupBy(*keys).agg(n.alias("n"), F.avg("v").alias("mean"), (F.var_pop("v") * n).alias("m2"), F.min("v").alias("least"))


def fit_moments_state(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, n, mean, m2, least): one pass for all columns; a column without values has no row."""
    return _moments(_stacked(df, cols), ["feature"])


def fit_group_state(df: DataFrame, main_columns: Sequence[str], uid: str, sentinel: float | None = None) -> DataFrame:
    """(uid, feature, n, mean, m2, least); ``sentinel`` counts as missing. Rows without a uid are left out."""
    rows = _stacked(df.where(F.col(uid).isNotNull()), main_columns, [F.col(uid).alias("uid")], sentinel)
    return _moments(rows.select("uid", "feature", "v"), ["uid", "feature"])


def merge_moments(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """The state of both inputs' rows together; either may be empty."""
    keys = list(keys)
    both = a.select(*keys, F.struct(*STATE).alias("a")).join(b.select(*keys, F.struct(*STATE).alias("b")), keys, "full_outer")
    na, nb = F.col("a.n").cast("double"), F.col("b.n").cast("double")
    d, n = F.col("b.mean") - F.col("a.mean"), F.col("a.n").cast("double") + F.col("b.n").cast("double")
    merged = F.struct((F.col("a.n") + F.col("b.n")).alias("n"), (F.col("a.mean") + d * nb / n).alias("mean"),
                      (F.col("a.m2") + F.col("b.m2") + d * d * na * nb / n).alias("m2"), F.least("a.least", "b.least").alias("least"))
    s = F.when(F.col("a").isNull(), F.col("b")).when(F.col("b").isNull(), F.col("a")).otherwise(merged)
    return both.select(*keys, s.alias("s")).select(*keys, "s.*")


def moments_of(state: DataFrame, population: bool = False) -> dict[str, tuple[float, float]]:
    """{column: (mean, std)}; one row per column comes to the driver. std is None where it is undefined."""
    out = {}
    for r in state.collect():
        free = r["n"] if population else r["n"] - 1
        out[r["feature"]] = (r["mean"], (max(r["m2"], 0.0) / free) ** 0.5 if free > 0 else None)
    return out


def standardize_from(df: DataFrame, state: DataFrame, cols: Sequence[str], population: bool = False) -> DataFrame:
    """A5 / A6 from a state; a column that the state does not have has no values, its result is null."""
    moments = moments_of(state, population)
    return scale.apply_standardize(df, {c: moments.get(c, (None, None)) for c in cols}, zero_std_to_one=population)


def min_shift_from(df: DataFrame, state: DataFrame, cols: Sequence[str], fill: float = -1) -> DataFrame:
    """A7 from a state."""
    least = {r["feature"]: r["least"] for r in state.select("feature", "least").collect()}
    return df.select(*[F.coalesce(F.col(c).cast("double") - F.lit(least.get(c)).cast("double"), F.lit(float(fill))).alias(c) if c in cols else F.col(c) for c in df.columns])


def group_stats_from(df: DataFrame, state: DataFrame, main_columns: Sequence[str], uid: str, aggregations: Sequence[str] = ("mean",),
                     fill: float | None = -1) -> DataFrame:
    """A3 from a state: ``{main}_{uid}_{agg}`` columns, joined back."""
    value = {"mean": F.col("mean"), "std": F.when(F.col("n") > 1, F.sqrt(F.greatest(F.col("m2"), F.lit(0.0)) / (F.col("n") - 1)))}
    aggs = [F.max(F.when(F.col("feature") == m, value[a])).alias(f"{m}_{uid}_{a}") for m in main_columns for a in aggregations]
    wide = state.groupBy(F.col("uid").alias(uid)).agg(*aggs)
    out = df.join(joins.sized_broadcast(cut_lineage(wide)), uid, "left")
    return out if fill is None else out.fillna(float(fill), subset=[f"{m}_{uid}_{a}" for m in main_columns for a in aggregations])


def fit_counts_state(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, s, i, n, d, count) of the non-null values of all columns, in one pass."""
    return encode._stack(df, cols).groupBy("feature", *encode.KEYS).agg(F.count(F.lit(1)).alias("count"))


def merge_counts(*states: DataFrame) -> DataFrame:
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out.groupBy("feature", *encode.KEYS).agg(F.sum("count").alias("count"))


def freq_from(df: DataFrame, state: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A2 from a counts state: ``{c}_FE``, null where the value is null or was never counted."""
    counts = cut_lineage(state)
    totals = counts.groupBy("feature").agg(F.sum("count").alias("_total"))  # one row per column
    table = cut_lineage(counts.join(F.broadcast(totals), "feature").withColumn("freq", F.col("count") / F.col("_total")).drop("count", "_total"))
    small = encode._broadcastable(table, cols)
    for c in cols:
        df = encode._attach(df, table, c, "freq", small).withColumnRenamed(f"_v_{c}", f"{c}_FE")
    return df
