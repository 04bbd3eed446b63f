"""Seeded exact sampling: balancing, splits, minibatches, first-n.

Every draw is an md5 of ``seed|id`` (see functions.hashing) and cuts are exact
(operators.ranking.hash_cut: only the bucket straddling the cut is ordered), so
results are identical across runs, partition counts and engines. No ``rand``,
``sample`` or ``randomSplit``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_uint32
from .ranking import hash_cut, hash_rank


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def undersample_balance(df: DataFrame, label: str, id_col: str, seed=73) -> DataFrame:
    """Keep, in every class, the ``min class size`` rows first in hash order."""
    smallest = class_sizes(df, label).agg(F.min("n")).first()[0] or 0
    cut = hash_cut(df, id_col, seed, lambda n: F.lit(smallest), by=[label], flag="_keep")
    return cut.where(F.col("_keep")).drop("_keep")


def split_exact(df: DataFrame, id_col: str, seed=42, test_ratio: float = 0.3, by=(), tag: str = "split",
                rounding: str = "floor") -> DataFrame:
    """``floor(n * ratio)`` rows (per ``by`` group when stratified) in hash order go to ``test``, the rest to
    ``train``; exact sizes, disjoint and complete. ``rounding="ceil"`` takes the ceiling, as the usual library does."""
    share = {"floor": F.floor, "ceil": F.ceil}[rounding]
    cut = hash_cut(df, id_col, seed, lambda n: share(n * F.lit(float(test_ratio))), by=list(by), flag="_test")
    return cut.withColumn(tag, F.when(F.col("_test"), F.lit("test")).otherwise(F.lit("train"))).drop("_test")


def split_stratified(df: DataFrame, id_col: str, label: str, seed=42, test_ratio: float = 0.2,
                     tag: str = "split", rounding: str = "floor") -> DataFrame:
    """R3. ``rounding="total"`` keeps the library's total: ``ceil(n * ratio)`` test rows in all, each class gets the floor
    of its share and the classes with the largest remainders one more (ties in label order)."""
    if rounding != "total":
        return split_exact(df, id_col, seed, test_ratio, by=[label], tag=tag, rounding=rounding)

    def cut_of(n):
        # over the bucket table: one row per class and bucket; ranks are taken among the classes
        whole = Window.partitionBy()
        total = F.sum("_cnt").over(whole)
        want = F.ceil(total * F.lit(float(test_ratio)))
        share = n * want / total
        first = F.row_number().over(Window.partitionBy(label).orderBy("_b")) == 1
        base = F.sum(F.when(first, F.floor(share))).over(whole)
        left = want - base
        order = Window.partitionBy(first).orderBy((share - F.floor(share)).desc(), F.col(label).asc_nulls_first())
        place = F.max(F.when(first, F.row_number().over(order))).over(Window.partitionBy(label))
        return F.floor(share) + F.when(place <= left, 1).otherwise(0)

    cut = hash_cut(df, id_col, seed, cut_of, by=[label], flag="_test")
    return cut.withColumn(tag, F.when(F.col("_test"), F.lit("test")).otherwise(F.lit("train"))).drop("_test")


def minibatch_ids(df: DataFrame, id_col: str, batch_size: int, seed=0, epoch: int = 0, out: str = "batch_id") -> DataFrame:
    """Rows in seeded hash order of ``seed|epoch|id``, cut into batches of exactly ``batch_size`` rows with one short
    last batch; reshuffled per epoch, no ordering of the whole table in one task."""
    ranked = hash_rank(df, id_col, f"{seed}|{epoch}", rank_col="_rank")
    return ranked.withColumn(out, F.floor((F.col("_rank") - 1) / F.lit(batch_size)).cast("int")).drop("_rank")


def first_n(df: DataFrame, id_col: str, n: int, seed=0) -> DataFrame:
    """L2: the first ``n`` rows in seeded hash order (top-n per partition, then merged)."""
    return (df.withColumn("_h", hash_uint32(seed, id_col)).orderBy("_h", id_col).limit(n).drop("_h"))
