"""Sparse features (E3, E4, M3): vectors as (size, sorted indices, values), so a column of many categories costs one index
per row and no column, and no category passes through the driver.

Categories are numbered by the code table (:func:`~keelson.operators.encode.fit_label_codes`, distributed); the features
lie one after the other in the vector. Weights and gradients are tables (idx, w): they grow with the categories, so they
are joined and grouped like any other table, by a broadcast only within the size bound."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import sigmoid
from ..session import cut_lineage
from . import encode, joins


@dataclass
class SparseLayout:
    """A fitted one-hot encoding: the code table, each feature's first index, and the number of indices."""

    codes: DataFrame
    offsets: dict[str, int]
    size: int


def fit_one_hot_sparse(train: DataFrame, cols: Sequence[str], first: int = 0) -> SparseLayout:
    """Codes of the non-null values of each column in sorted order; one number per column comes to the driver."""
    codes = encode.fit_label_codes(train, cols)
    counts = {r["feature"]: r["n"] for r in codes.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, at = {}, first
    for c in cols:
        offsets[c] = at
        at += counts.get(c, 0)
    return SparseLayout(codes, offsets, at)


def _vector(size: int, pairs: Column) -> Column:
    """Struct (size, indices, values) of an array of (i, v) structs, sorted, without zeros and nulls."""
    kept = F.sort_array(F.filter(pairs, lambda p: p["i"].isNotNull() & p["v"].isNotNull() & (p["v"] != 0)))
    return F.struct(F.lit(size).cast("bigint").alias("size"), F.transform(kept, lambda p: p["i"]).alias("indices"),
                    F.transform(kept, lambda p: p["v"]).alias("values"))


def one_hot_sparse(df: DataFrame, cols: Sequence[str], layout: SparseLayout, out: str = "vec", dense: Sequence[str] = ()) -> DataFrame:
    """E3 + E4: column ``out`` with a 1 at each column's category; a null or unseen value has no index. ``dense`` number
    columns come first (fit the layout with ``first=len(dense)``)."""
    small = encode._broadcastable(layout.codes, cols)
    x = df
    for c in cols:
        x = encode._attach(x, layout.codes, c, "code", small)
    pairs = [F.struct(F.lit(k).cast("bigint").alias("i"), F.col(c).cast("double").alias("v")) for k, c in enumerate(dense)]
    pairs += [F.struct((F.col(f"_v_{c}") + F.lit(layout.offsets[c])).cast("bigint").alias("i"), F.lit(1.0).alias("v")) for c in cols]
    return x.withColumn(out, _vector(layout.size, F.array(*pairs))).drop(*[f"_v_{c}" for c in cols])


def _terms(df: DataFrame, vec: str, keep: Sequence[str]) -> DataFrame:
    """(keep ..., i, v) rows, one per entry; a row without entries has one of nulls."""
    entries = F.arrays_zip(F.col(f"{vec}.indices").alias("i"), F.col(f"{vec}.values").alias("v"))
    return df.select(*keep, F.explode_outer(entries).alias("_e")).select(*keep, F.col("_e.i").alias("_i"), F.col("_e.v").alias("_x"))


def sparse_logit(df: DataFrame, vec: str, weights: DataFrame, bias: float, keep: Sequence[str], out: str = "logit") -> DataFrame:
    """M3: ``w . x + bias`` per row from a weights table (idx, w); an index without a weight counts 0. ``keep`` names the
    columns that identify a row and that are returned."""
    w = joins.sized_broadcast(weights.select(F.col("idx").alias("_i"), F.col("w").alias("_w")))
    terms = _terms(df, vec, keep).join(w, "_i", "left")
    return terms.groupBy(*keep).agg((F.coalesce(F.sum(F.col("_x") * F.col("_w")), F.lit(0.0)) + F.lit(float(bias))).alias(out))


def sparse_score(df: DataFrame, vec: str, weights: DataFrame, bias: float, keep: Sequence[str], out: str = "p") -> DataFrame:
    """The sigmoid of :func:`sparse_logit`."""
    return sparse_logit(df, vec, weights, bias, keep, "_z").withColumn(out, sigmoid(F.col("_z"))).drop("_z")


def sparse_gradient(df: DataFrame, vec: str, label: str, weights: DataFrame, bias: float, id_col: str) -> DataFrame:
    """Mean gradient of the binary cross-entropy as a table (idx, g), idx -1 for the bias; indices that no row has are
    absent. Entries are summed per task before the shuffle, so a category that nearly all rows have is combined there."""
    scored = sparse_score(df, vec, weights, bias, [id_col, label], "_p").select(id_col, (F.col("_p") - F.col(label).cast("double")).alias("_r"))
    n = F.count(F.lit(1)).cast("double")
    scored = cut_lineage(scored)
    total = scored.agg(F.sum("_r").alias("r"), n.alias("n")).first()
    if not total["n"]:
        return df.sparkSession.createDataFrame([], "idx bigint, g double")
    g = _terms(df, vec, [id_col]).where("_i IS NOT NULL").join(scored, id_col).groupBy(F.col("_i").alias("idx")).agg(
        (F.sum(F.col("_r") * F.col("_x")) / F.lit(total["n"])).alias("g"))
    bias_row = df.sparkSession.createDataFrame([(-1, total["r"] / total["n"])], "idx bigint, g double")
    return g.unionByName(bias_row)


def sparse_train_gd(df: DataFrame, vec: str, label: str, id_col: str, epochs: int, lr: float) -> tuple[DataFrame, float]:
    """Gradient descent from zero: (weights table (idx, w), bias). Weights stay a table from epoch to epoch."""
    weights, bias = df.sparkSession.createDataFrame([], "idx bigint, w double"), 0.0
    data = cut_lineage(df.select(id_col, label, vec))
    for _ in range(epochs):
        g = cut_lineage(sparse_gradient(data, vec, label, weights, bias, id_col))
        row = g.where("idx = -1").first()
        bias -= lr * (row["g"] if row else 0.0)
        step = g.where("idx >= 0").select("idx", (F.col("g") * F.lit(-lr)).alias("w"))
        weights = cut_lineage(weights.unionByName(step).groupBy("idx").agg(F.sum("w").alias("w")))
    return weights, bias
