"""Query registry: name -> Spark query (spark, sf_dir) -> DataFrame, and the
DuckDB SQL that computes the same rows (absent for rows-only checks).

Output conventions shared by both sides, so results compare exactly:
integers are BIGINT, computed doubles are rounded by ``floor(x * 10^p + 0.5) / 10^p``
(plain IEEE arithmetic, the same in both engines), arrays are reported in long
form (id, pos, value).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import round_half_up

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
INVENTORY: dict[str, str] = {}


def query(name: str, ids: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        INVENTORY[name] = ids
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def r(name: str, expr: Column | None = None, places: int = 6) -> Column:
    """Rounded double output column ``name``."""
    return round_half_up(expr if expr is not None else F.col(name), places).alias(name)


def b(name: str, expr: Column | None = None) -> Column:
    """BIGINT output column ``name``."""
    return (expr if expr is not None else F.col(name)).cast("bigint").alias(name)


def sr(expr: str, places: int = 6) -> str:
    """SQL twin of :func:`r`."""
    return f"floor(({expr})::DOUBLE * 1e{places} + 0.5) / 1e{places}"


def long_form(df: DataFrame, id_cols: list[str], arr: str, places: int = 6, pos: str = "pos",
              value: str = "value") -> DataFrame:
    """(ids..., pos 0-based, value rounded) rows of an array column."""
    x = df.select(*id_cols, F.posexplode(arr).alias("_p", "_v"))
    return x.select(*[b(c) for c in id_cols], F.col("_p").cast("bigint").alias(pos), r(value, F.col("_v")))
