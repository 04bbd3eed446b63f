"""Connected components of links by alternating large-star and small-star steps.

Each step is a grouping and a join on narrow rows; the frame is cut to Parquet in the shared folder after each round,
and only a row of checksums comes to the driver. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _least(pairs: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, m): m the least of u and its v's."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least"))
    return pairs.join(least, "u").select("u", "v", F.least("u", "least").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    x = _least(down)
    moved = x.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(x.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id of ``links`` (a, b): the least id that it reaches."""
    edges = materialize(links.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v").distinct(), "links")
    seen = None
    while True:
        edges = materialize(_small_star(_large_star(edges)), "components")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = edges.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
