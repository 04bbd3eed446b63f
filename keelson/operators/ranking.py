"""Exact ranks and running sums without a one-partition window.

A window with no (or few) partition keys runs in a single task. These helpers
split the order into buckets that are monotone in the sort key, count rows per
bucket (a small table), turn the counts into offsets with a prefix sum over that
small table, and finish with a window partitioned by bucket. The result is the
same as a global ``row_number`` / running ``sum`` but every heavy step is spread
over many tasks, and a key holding a third of the rows is spread over buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_uint32
from ..session import cut_lineage

def hash_rank(df: DataFrame, id_col: str, seed, by: Sequence[str] = (), bits: int = 20,
              rank_col: str = "rank", size_col: str | None = None) -> DataFrame:
    """1-based rank within ``by`` groups, ordered by (md5 draw of ``seed|id``, id).

    Equivalent to ``row_number() OVER (PARTITION BY by ORDER BY h, id)``.
    ``size_col`` optionally carries the group size.
    """
    by = list(by)
    h = hash_uint32(seed, id_col)
    x = df.withColumn("_h", h).withColumn("_b", F.shiftright(F.col("_h"), 32 - bits))
    counts = x.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*by).orderBy("_b")
    counts = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    keep = [*by, "_b", "_off"]
    if size_col:
        counts = counts.withColumn(size_col, F.sum("_n").over(Window.partitionBy(*by)))
        keep.append(size_col)
    # null-safe on the group keys: a null class is a class, not a dropped row
    c = counts.select(*[F.col(k).alias(f"_g_{k}") for k in by], *[k for k in keep if k not in by])
    c = c.withColumnRenamed("_b", "_cb")
    cond = F.col("_b") == F.col("_cb")
    for k in by:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
    x = x.join(c, cond).drop("_cb", *[f"_g_{k}" for k in by])
    rn = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", id_col))
    return x.withColumn(rank_col, (F.col("_off") + rn).cast("bigint")).drop("_h", "_b", "_off")


def ranged_codes(rows: DataFrame, group: Sequence[str], order: Sequence[str], code_col: str = "code") -> DataFrame:
    """0-based place of each of the distinct ``rows`` within its group in the order of ``order``, by range partitions:
    rows are counted per partition and group, the counts become offsets, and only a partition's own rows are sorted."""
    group = list(group)
    ranged = cut_lineage(rows.repartitionByRange(*group, *order).withColumn("_pid", F.spark_partition_id()))
    counts = ranged.groupBy(*group, "_pid").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_off", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    place = F.row_number().over(Window.partitionBy(*group, "_pid").orderBy(*order))
    out = ranged.join(counts, [*group, "_pid"])
    return out.withColumn(code_col, (F.col("_off") + place - 1).cast("int")).drop("_pid", "_off")


def dense_codes(values: DataFrame, col: str, code_col: str = "code") -> DataFrame:
    """0-based dense codes of the distinct non-null values of ``col`` in sorted order."""
    vals = values.select(col).where(F.col(col).isNotNull()).distinct()
    return ranged_codes(vals, [], [col], code_col)


def running_sums_desc(df: DataFrame, score_col: str, value_cols: Sequence[str], bucket: Column,
                      prefix: str = "cum_") -> DataFrame:
    """Running sums of ``value_cols`` in descending ``score_col`` order, rows with
    one score per row (group first). ``bucket`` must be non-decreasing in score."""
    x = df.withColumn("_b", bucket)
    per = x.groupBy("_b").agg(*[F.sum(v).alias(f"_t_{v}") for v in value_cols])
    before = Window.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_b", *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in value_cols])
    x = x.join(per, "_b")
    within = Window.partitionBy("_b").orderBy(F.col(score_col).desc()).rowsBetween(Window.unboundedPreceding, 0)
    for v in value_cols:
        x = x.withColumn(f"{prefix}{v}", F.col(f"_o_{v}") + F.sum(v).over(within))
    return x.drop("_b", *[f"_o_{v}" for v in value_cols])


def next_desc(df: DataFrame, score_col: str, value_cols: Sequence[str], bucket: Column,
              prefix: str = "next_") -> DataFrame:
    """For rows with one score per row, the values of the next row in descending
    score order (null for the last), without a one-task window: ``lead`` within
    the bucket, and for a bucket's last row the first row of the next lower
    non-empty bucket, taken from the small per-bucket table."""
    x = df.withColumn("_b", bucket)
    first = Window.partitionBy("_b").orderBy(F.col(score_col).desc())
    heads = (x.withColumn("_r", F.row_number().over(first)).where(F.col("_r") == 1)
             .select("_b", *[F.col(v).alias(f"_h_{v}") for v in value_cols]))
    down = Window.orderBy(F.col("_b").desc())
    heads = heads.select("_b", *[F.lead(f"_h_{v}").over(down).alias(f"_n_{v}") for v in value_cols])
    x = x.join(heads, "_b")
    for v in value_cols:
        x = x.withColumn(f"{prefix}{v}", F.coalesce(F.lead(v).over(first), F.col(f"_n_{v}")))
    return x.drop("_b", *[f"_n_{v}" for v in value_cols])


def hash_cut(df: DataFrame, id_col: str, seed, cut_of, by: Sequence[str] = (), bits: int = 16,
             flag: str = "in_cut") -> DataFrame:
    """Boolean ``flag``: is the row's rank (within ``by``, in (md5 draw, id) order, as
    :func:`hash_rank`) at most ``cut_of(group_size)``?

    Only the rows of the one bucket per group that straddles the cut need an
    ordering: every other bucket lies wholly below or above it. The small bucket
    table (offsets and state) is materialised and joined by a size-checked
    broadcast, so the data takes a map-only pass; the boundary rows alone go
    through a window."""
    from .joins import sized_broadcast

    by = list(by)
    x = df.withColumn("_h", hash_uint32(seed, id_col)).withColumn("_b", F.shiftright(F.col("_h"), 32 - bits))
    counts = x.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = (counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
                    .withColumn("_n", F.sum("_cnt").over(Window.partitionBy(*by))))
    counts = counts.withColumn("_cut", cut_of(F.col("_n")).cast("long"))
    counts = counts.withColumn("_state", F.when(F.col("_off") + F.col("_cnt") <= F.col("_cut"), F.lit(1))
                                          .when(F.col("_off") >= F.col("_cut"), F.lit(0)).otherwise(F.lit(-1)))
    table = counts.select(*[F.col(k).alias(f"_g_{k}") for k in by], F.col("_b").alias("_cb"), "_state", "_off", "_cut")
    table = sized_broadcast(cut_lineage(table))
    cond = F.col("_b") == F.col("_cb")
    for k in by:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
    x = x.join(table, cond).drop("_cb", *[f"_g_{k}" for k in by])
    settled = x.where(F.col("_state") >= 0).withColumn(flag, F.col("_state") == F.lit(1))
    rn = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", id_col))
    edge = x.where(F.col("_state") < 0).withColumn(flag, F.col("_off") + rn <= F.col("_cut"))
    return settled.unionByName(edge).drop("_h", "_b", "_state", "_off", "_cut")
