"""Stand-in datasets built from the scale-factor tables, each with its SQL twin.

* order features ("wide transactions"): orders left join per-order lineitem
  aggregates; 0/1 label = urgent or high priority. Orders without lines give nulls.
* images: ``embeddings`` read as 8x8 single-channel images with a class label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import assemble
from ..tables import table

# Fixed values of the stand-in model: feature scales, linear weights and bias.
FEATURE_SCALES = (1.0 / 100000.0, 1.0 / 7.0, 1.0 / 100.0, 10.0, 10.0)
LINEAR_WEIGHTS = (-0.125, 0.3125, 0.0625, -0.1875, 0.25)
LINEAR_BIAS = -0.25
POSITIVE_PRIORITIES = ("1-URGENT", "2-HIGH")
IMAGE_H = IMAGE_W = 8


def order_features(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("sum_qty"),
        F.avg("l_discount").alias("avg_disc"), F.avg("l_tax").alias("avg_tax"),
        F.sum((F.col("l_returnflag") == F.lit("R")).cast("long")).alias("n_returned"),
        F.max("l_extendedprice").alias("max_price"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return o.join(li, o["o_orderkey"] == li["l_orderkey"], "left").drop("l_orderkey").withColumn(
        "label", F.col("o_orderpriority").isin(*POSITIVE_PRIORITIES).cast("int"))


ORDER_FEATURES_SQL = """order_features AS (
  SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_totalprice, o.o_orderpriority,
         li.n_lines, li.sum_qty, li.avg_disc, li.avg_tax, li.n_returned, li.max_price,
         CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS label
  FROM orders o LEFT JOIN (
    SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS sum_qty, avg(l_discount) AS avg_disc,
           avg(l_tax) AS avg_tax, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_returned,
           max(l_extendedprice) AS max_price
    FROM lineitem GROUP BY l_orderkey) li ON o.o_orderkey = li.l_orderkey)"""


def feature_columns() -> list[Column]:
    s = FEATURE_SCALES
    return [F.col("o_totalprice") * F.lit(s[0]), F.coalesce(F.col("n_lines"), F.lit(0)).cast("double") * F.lit(s[1]),
            F.coalesce(F.col("sum_qty"), F.lit(0.0)) * F.lit(s[2]), F.coalesce(F.col("avg_disc"), F.lit(0.0)) * F.lit(s[3]),
            F.coalesce(F.col("avg_tax"), F.lit(0.0)) * F.lit(s[4])]


def order_vectors(spark: SparkSession, d: str) -> DataFrame:
    """o_orderkey, features array<double> (5), label."""
    return order_features(spark, d).select("o_orderkey", assemble(feature_columns()).alias("features"), "label")


def _sql_double(x: float) -> str:
    return f"{x!r}::DOUBLE"


FEATURE_SQL = [
    f"o_totalprice * {_sql_double(FEATURE_SCALES[0])}",
    f"coalesce(n_lines, 0)::DOUBLE * {_sql_double(FEATURE_SCALES[1])}",
    f"coalesce(sum_qty, 0.0::DOUBLE) * {_sql_double(FEATURE_SCALES[2])}",
    f"coalesce(avg_disc, 0.0::DOUBLE) * {_sql_double(FEATURE_SCALES[3])}",
    f"coalesce(avg_tax, 0.0::DOUBLE) * {_sql_double(FEATURE_SCALES[4])}",
]


def sql_logit(weights=LINEAR_WEIGHTS, bias=LINEAR_BIAS, feats=None) -> str:
    feats = feats or FEATURE_SQL
    terms = " + ".join(f"({f}) * {_sql_double(w)}" for f, w in zip(feats, weights))
    return f"((0.0::DOUBLE + {terms}) + {_sql_double(bias)})"


def sql_sigmoid(z: str) -> str:
    return f"(1.0::DOUBLE / (1.0::DOUBLE + exp(-({z}))))"


def images(spark: SparkSession, d: str) -> DataFrame:
    """image_id, pixels array<float> (64 = 8x8), label."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("embedding").alias("pixels"),
                                                F.col("label"))
