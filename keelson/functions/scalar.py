"""Scalar feature functions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import _as_col


def round_half_up(c, places: int = 6) -> Column:
    """floor(x * 10^p + 0.5) / 10^p: plain IEEE arithmetic, identical in any engine."""
    scale = float(10 ** places)
    return F.floor(_as_col(c).cast("double") * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def sigmoid(z) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_as_col(z)))


def threshold_label(p, cut: float = 0.5) -> Column:
    """Strict ``p > cut`` as 0/1 (p == cut is class 0)."""
    return (_as_col(p) > F.lit(cut)).cast("int")


def close_enough(p, y, tol: float = 0.5) -> Column:
    """Correct-if-close: ``|p - y| < tol`` (at p = 0.5 always wrong)."""
    return F.abs(_as_col(p) - _as_col(y)) < F.lit(tol)


def flag_equals(c, value) -> Column:
    """Equality flag where a null input gives false, not null."""
    return _as_col(c).eqNullSafe(F.lit(value))


def extract_first(c, pattern: str, group: int = 1) -> Column:
    """First regex match group; no match or null input gives null."""
    return F.nullif(F.regexp_extract(_as_col(c), pattern, group), F.lit(""))


# The two extraction patterns of the passenger preprocessing.
LETTER_RUN = "([A-Za-z]+)"
TITLE_BEFORE_DOT = " ([A-Za-z]+)\\."


def fractional_part(c) -> Column:
    x = _as_col(c).cast("double")
    return x - F.floor(x).cast("double")


def capped_sum(a, b, cap: float = 6) -> Column:
    s = _as_col(a) + _as_col(b)
    return F.when(s > F.lit(cap), F.lit(cap)).otherwise(s)


def bin_left_closed(c, edges: Sequence[float], labels: Sequence[str], unknown: str = "Unknown") -> Column:
    """Bins [e_i, e_{i+1}); null or outside all bins gives ``unknown``."""
    if len(labels) != len(edges) - 1:
        raise ValueError("need len(edges) - 1 labels")
    x = _as_col(c)
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (x >= F.lit(float(lo))) & (x < F.lit(float(hi)))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr.otherwise(F.lit(unknown))


def bin_right_closed(c, edges: Sequence[float], labels: Sequence[str], unknown: str = "Unknown") -> Column:
    """Bins (e_i, e_{i+1}]; edges may be +-inf; null or outside gives ``unknown``."""
    if len(labels) != len(edges) - 1:
        raise ValueError("need len(edges) - 1 labels")
    x = _as_col(c)
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = x > F.lit(float(lo))
        if not math.isinf(hi):
            cond = cond & (x <= F.lit(float(hi)))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr.otherwise(F.lit(unknown))


def interaction(a, b) -> Column:
    """Product of two features; booleans count as 0/1."""
    return _as_col(a).cast("double") * _as_col(b).cast("double")


def replace_mapping(c, mapping: dict) -> Column:
    """Map values through a fixed dictionary; unmapped values are kept."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _as_col(c)), _as_col(c))


def round_half_even(c, places: int = 0) -> Column:
    return F.bround(_as_col(c), places)
