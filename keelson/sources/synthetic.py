"""Separable rows derived from a key column (S7): label = x0 >= x1.

Two normal draws per key by Box-Muller on md5 uniforms, so the rows are the same
on any cluster and in SQL.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_uniform


def _normal(seed, key: str, k: int):
    u1 = F.lit(1.0) - hash_uniform(seed, key, F.lit(2 * k))      # (0, 1]
    u2 = hash_uniform(seed, key, F.lit(2 * k + 1))
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def separable_rows(keys: DataFrame, key: str, seed: int = 0, n: int = 2) -> DataFrame:
    df = keys.select(F.col(key).alias("row_id"))
    for k in range(n):
        df = df.withColumn(f"x{k}", _normal(seed, "row_id", k))
    return df.withColumn("label", (F.col("x0") >= F.col("x1")).cast("int"))
