"""Scaling (A5-A7). Fitting is one global aggregate for all columns (a single
row of d numbers); applying is a projection with those numbers as literals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_moments(df: DataFrame, cols: Sequence[str], population: bool = False) -> dict[str, tuple[float, float]]:
    std = F.stddev_pop if population else F.stddev_samp
    aggs = []
    for c in cols:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"m_{c}"), std(F.col(c).cast("double")).alias(f"s_{c}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in cols}


def apply_standardize(df: DataFrame, moments: dict[str, tuple[float, float]], zero_std_to_one: bool) -> DataFrame:
    """``(x - m) / s`` with fitted literals. A zero or undefined s gives 1 when
    ``zero_std_to_one`` (the scaler convention), else a null result."""
    cols = []
    for c in df.columns:
        if c not in moments:
            cols.append(F.col(c))
            continue
        m, s = moments[c]
        if s is None or s == 0:
            if not zero_std_to_one:
                cols.append(F.lit(None).cast("double").alias(c))
                continue
            s = 1.0
        cols.append(((F.col(c).cast("double") - F.lit(m)) / F.lit(s)).alias(c))
    return df.select(*cols)


def standardize_sample(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """A5: ``(x - mean) / std_sample``."""
    return apply_standardize(df, fit_moments(fit_on if fit_on is not None else df, cols), zero_std_to_one=False)


def standardize_population(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """``(x - mean) / std_population``; a constant column divides by 1."""
    return apply_standardize(df, fit_moments(fit_on if fit_on is not None else df, cols, population=True),
                             zero_std_to_one=True)


def fit_minimums(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    row = df.agg(*[F.min(F.col(c).cast("double")).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols}


def min_shift(df: DataFrame, cols: Sequence[str], exempt: Sequence[str] = (), fit_on: DataFrame | None = None,
              fill: float = -1) -> DataFrame:
    """``x - min(x)`` over the fitting frame (train and test together), null to ``fill``.
    Exempt columns are left as they are: neither shifted nor filled."""
    shift = [c for c in cols if c not in set(exempt)]
    mins = fit_minimums(fit_on if fit_on is not None else df, shift)
    out = []
    for c in df.columns:
        if c in mins:
            expr = F.col(c).cast("double") - F.lit(mins[c]) if mins[c] is not None else F.col(c).cast("double")
            out.append(F.coalesce(expr, F.lit(float(fill))).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)
