"""The flagship query: score every order with the fixed linear model and
report confusion counts, precision, recall, F1 and accuracy in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import threshold_label
from ..operators import metrics as M
from ..operators.linear import linear_score
from . import datasets as ds
from .registry import b, query, r, sr


def flagship(spark: SparkSession, d: str) -> DataFrame:
    vec = ds.order_vectors(spark, d)
    scored = linear_score(vec, "features", ds.LINEAR_WEIGHTS, ds.LINEAR_BIAS).withColumn("pred", threshold_label("p"))
    c = scored.agg(*M.binary_counts(scored, "label", "pred"), F.count(F.lit(1)).alias("n"))
    div = M._div
    return c.select(b("n"), b("tp"), b("fp"), b("fn"), b("tn"),
                    r("precision", div(F.col("tp"), F.col("tp") + F.col("fp"))),
                    r("recall", div(F.col("tp"), F.col("tp") + F.col("fn"))),
                    r("f1", div(F.col("tp") * 2, F.col("tp") * 2 + F.col("fp") + F.col("fn"))),
                    r("accuracy", div(F.col("tp") + F.col("tn"), F.col("n"))))


_SCORED = f"""{ds.ORDER_FEATURES_SQL}, scored AS (
  SELECT label, (({ds.sql_sigmoid(ds.sql_logit())}) > 0.5)::INT AS pred FROM order_features),
c AS (SELECT count(*) AS n, sum(CASE WHEN label = 1 AND pred = 1 THEN 1 ELSE 0 END) AS tp,
             sum(CASE WHEN label <> 1 AND pred = 1 THEN 1 ELSE 0 END) AS fp,
             sum(CASE WHEN label = 1 AND pred <> 1 THEN 1 ELSE 0 END) AS fn,
             sum(CASE WHEN label <> 1 AND pred <> 1 THEN 1 ELSE 0 END) AS tn FROM scored)"""


@query("flagship_order_metrics", "P6 M3 A8 A9 A10", sql=f"""
WITH {_SCORED}
SELECT n::BIGINT AS n, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn,
       {sr("CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END")} AS precision,
       {sr("CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn) END")} AS recall,
       {sr("CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE (2 * tp)::DOUBLE / (2 * tp + fp + fn) END")} AS f1,
       {sr("CASE WHEN n = 0 THEN 0.0 ELSE (tp + tn)::DOUBLE / n END")} AS accuracy FROM c""")
def q_flagship(spark, d):
    return flagship(spark, d)
