"""Array (vector) expressions: dot products, distances, activations, arg-max.

All stay in the JVM. Element accesses are compiled by whole-stage codegen; higher-order functions are evaluated row
by row inside it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import _as_col


def assemble(cols: Sequence) -> Column:
    """Numeric columns -> array<double>."""
    return F.array(*[_as_col(c).cast("double") for c in cols])


def as_double_array(c) -> Column:
    return F.transform(_as_col(c), lambda x: x.cast("double"))


def array_sum(c) -> Column:
    return F.aggregate(_as_col(c), F.lit(0.0), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    """Sum of element products, left to right."""
    return array_sum(F.zip_with(as_double_array(a), as_double_array(b), lambda x, y: x * y))


# Up to this many weights a dot product is unrolled into element accesses, which
# whole-stage codegen compiles; higher-order functions are evaluated row by row.
UNROLL_MAX = 1024


def dot_literal(a, weights: Sequence[float]) -> Column:
    """``a . w`` for a fixed weight vector (one fitted model), summed left to right
    from 0.0 (the same order as the higher-order form, so results are identical)."""
    if len(weights) <= UNROLL_MAX:
        x = _as_col(a)
        acc = F.lit(0.0)
        for j, v in enumerate(weights):
            acc = acc + x[j].cast("double") * F.lit(float(v))
        return acc
    w = F.array(*[F.lit(float(v)) for v in weights])
    return dot(a, w)


def squared_distance(a, b) -> Column:
    """Squared Euclidean distance."""
    return array_sum(F.zip_with(as_double_array(a), as_double_array(b), lambda x, y: (x - y) * (x - y)))


def square(c) -> Column:
    return F.transform(_as_col(c), lambda x: x * x)


def relu(c) -> Column:
    return F.transform(_as_col(c), lambda x: F.greatest(x, F.lit(0.0)))


def argmax(c) -> Column:
    """0-based index of the largest element; first one on ties (L3)."""
    a = _as_col(c)
    return (F.array_position(a, F.array_max(a)) - F.lit(1)).cast("int")


def normalize(c, mean: float, std: float, scale: float = 1.0) -> Column:
    """``(x * scale - mean) / std`` per element."""
    return F.transform(_as_col(c), lambda x: (x.cast("double") * F.lit(float(scale)) - F.lit(float(mean))) / F.lit(float(std)))


def fixed_point(c, frac_bits: int) -> Column:
    """Round each element to the grid 2^-frac_bits (half to even)."""
    s = float(2 ** frac_bits)
    return F.transform(_as_col(c), lambda x: F.rint(x.cast("double") * F.lit(s)) / F.lit(s))


def flatten_nested(c) -> Column:
    """array<array<T>> -> array<T>, row-major."""
    return F.flatten(_as_col(c))


def log_sum_exp(c) -> Column:
    """Max-shifted log-sum-exp of a logit array."""
    a = as_double_array(c)
    m = F.array_max(a)
    return m + F.log(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))
