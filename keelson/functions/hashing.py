"""Seeded, portable pseudo-randomness.

A row's random draw is ``md5(seed|key...)``: the same text in Spark and in any
SQL engine, independent of partitioning, and stable when a task is retried.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_hex(seed, *keys) -> Column:
    parts = [F.lit(str(seed))] + [_as_col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts))


def hash_uint32(seed, *keys) -> Column:
    """First 8 hex digits of the md5 as a non-negative bigint in [0, 2^32)."""
    return F.conv(F.substring(hash_hex(seed, *keys), 1, 8), 16, 10).cast("bigint")


def hash_uniform(seed, *keys) -> Column:
    """Uniform double in [0, 1)."""
    return hash_uint32(seed, *keys) / F.lit(TWO_32)


def sql_hash_uint32(seed, *keys: str) -> str:
    """DuckDB text of :func:`hash_uint32` for oracles and docs."""
    inner = ", ".join([f"'{seed}'"] + list(keys))
    return f"('0x' || substr(md5(concat_ws('|', {inner})), 1, 8))::BIGINT"


def sql_hash_uniform(seed, *keys: str) -> str:
    return f"({sql_hash_uint32(seed, *keys)} / 4294967296.0)"
