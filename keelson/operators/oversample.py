"""SMOTE oversampling (R4): every smaller class is grown to the majority size
with points interpolated between a class member and one of its k nearest
class neighbours.

All classes are grown in one plan. Members are numbered within their class in
seeded hash order; member r of a class of n makes the synthetic rows s = r,
r + n, r + 2n, ... below the class's deficit, so every member explodes its own
share. The neighbours of the members that make rows come from one kNN within classes.
Row s takes neighbour number ``1 + draw(s) mod k`` and gap ``uniform(s)``.

A class with fewer than k + 1 members has only the neighbours it has; a class
of one member is grown by copies of it. Rows without a label are kept and form
no class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_uint32, hash_uniform
from ..session import cut_lineage, cut_packed, release
from .joins import sized_broadcast
from .knn import knn
from .ranking import hash_rank


def smote(df: DataFrame, id_col: str, vec_col: str, label_col: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Original rows plus synthetic ones: id, vec (array<double>), label, synthetic (0/1).
    Synthetic ids continue after the largest input id, class by class in label order."""
    base = df.select(F.col(id_col).cast("long").alias("id"),
                     F.transform(vec_col, lambda x: x.cast("double")).alias("vec"),
                     F.col(label_col).cast("long").alias("label"))
    out = base.withColumn("synthetic", F.lit(0))
    # one row per class: its deficit, the first id of its synthetic rows and the number before its first member
    classes = base.where(F.col("label").isNotNull()).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy()
    before = Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("n_new", F.max("n").over(whole) - F.col("n"))
    classes = classes.withColumn("ahead", F.coalesce(F.sum("n_new").over(before), F.lit(0)))
    classes = classes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("n_new") > 0)
    max_id = base.agg(F.max("id")).first()[0] or 0
    ranked = hash_rank(base.join(sized_broadcast(cut_lineage(classes)), "label"), "id", seed, by=["label"], rank_col="r")
    ranked = cut_packed(ranked.withColumn("no", F.col("start") + F.col("r")).drop("start"))
    release(df.sparkSession)
    # members that make rows, with those of the same id as the last of them: only their neighbours are looked for
    last = cut_lineage(ranked.where(F.col("r") == F.col("n_new")).select("label", F.col("id").alias("last")))
    makers = ranked.join(sized_broadcast(last), "label", "left").where((F.col("r") <= F.col("n_new")) | (F.col("id") == F.col("last")))
    # neighbours by number; the vector of the one that a row takes is fetched afterwards
    near = knn(makers, ranked, k, "id", "vec", "id", "vec", "no", exclude_self=True, group="label")
    near = near.groupBy(F.col("query_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", "neighbor_label"))).alias("near"))
    rows = ranked.where(F.col("r") <= F.col("n_new")).join(near, "id", "left")
    rows = rows.withColumn("s", F.explode(F.sequence(F.col("r") - 1, F.col("n_new") - 1, F.col("n"))))
    tag = lambda name: F.concat(F.lit(name), F.col("label").cast("string"))
    pick = F.pmod(hash_uint32(seed, tag("nb"), "s"), F.size("near")) + 1
    other = F.when(F.col("near").isNull(), F.col("no")).otherwise(F.element_at("near", pick.cast("int"))["neighbor_label"])
    rows = rows.select("s", "label", "ahead", "vec", other.alias("other_no"), hash_uniform(seed, tag("gap"), "s").alias("gap"))
    rows = rows.join(ranked.select(F.col("no").alias("other_no"), F.col("vec").alias("other")), "other_no")
    synthetic = rows.select((F.lit(max_id + 1) + F.col("ahead") + F.col("s")).cast("long").alias("id"),
                            F.zip_with("vec", "other", lambda x, y: x + F.col("gap") * (y - x)).alias("vec"),
                            "label", F.lit(1).alias("synthetic"))
    return out.unionByName(synthetic)
