"""The diabetes workflow on its CSV file (schema in FIXTURES.md): drop rows with
nulls, undersample to the smallest class, exact split, standardise (sample std),
LR by gradient descent, and the two kNN classifiers; metrics for each model.

Differences on purpose (SURVEY 2.12): split before scaling (scales are fitted on
train), a seeded split, equal k is a parameter of both kNN variants.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import assemble
from ..operators import clean, knn, linear, metrics, sample, scale
from ..session import cut_lineage
from ..sources.csv import read_csv

# Fixed values of the diabetes workflow, as the reference states them.
FEATURES = ["Pregnancies", "Glucose", "BloodPressure", "SkinThickness", "Insulin", "BMI",
            "DiabetesPedigreeFunction", "Age"]
DOUBLE_FEATURES = ["BMI", "DiabetesPedigreeFunction"]
LABEL = "Outcome"
BALANCE_SEED = 73
TEST_RATIO = 0.3
EPOCHS = 200
LEARNING_RATE = 0.1
K_MAJORITY = 5
K_MEAN = 3

SCHEMA = T.StructType([T.StructField(c, T.DoubleType() if c in DOUBLE_FEATURES else T.LongType(), True)
                       for c in FEATURES] + [T.StructField(LABEL, T.LongType(), True)])


def _metrics_row(name: str, scored: DataFrame) -> tuple[str, dict]:
    scored = cut_lineage(scored.select(LABEL, "p", "pred"))
    return name, metrics.binary_report(scored, LABEL, "p", "pred")


def diabetes_workflow(spark: SparkSession, csv_path: str, seed: int = 42, epochs: int = EPOCHS,
                      lr: float = LEARNING_RATE) -> DataFrame:
    df = read_csv(spark, csv_path, SCHEMA)
    # the file has no key: a row's id is a hash of its content and of its place among equal rows, so splits do not depend
    # on the file's layout
    df = clean.drop_null_rows(df)
    same = F.row_number().over(Window.partitionBy(*df.columns).orderBy(F.lit(1)))
    df = cut_lineage(df.withColumn("_same", same).withColumn("row_id", F.xxhash64(*df.columns, "_same")).drop("_same"))
    df = sample.undersample_balance(df, LABEL, "row_id", seed=BALANCE_SEED)
    df = cut_lineage(sample.split_exact(df, "row_id", seed=seed, test_ratio=TEST_RATIO))
    train = df.where(F.col("split") == "train")
    df = scale.standardize_sample(df, FEATURES, fit_on=train)
    vec = cut_lineage(df.select("row_id", "split", assemble(FEATURES).alias("x"), F.col(LABEL).cast("int").alias(LABEL)))
    tr, te = vec.where(F.col("split") == "train"), vec.where(F.col("split") == "test")
    model = linear.train_gd(tr, "x", LABEL, epochs=epochs, lr=lr)
    rows = [_metrics_row("lr_gd", linear.predict(te, "x", model))]
    for k, vote in ((K_MAJORITY, knn.majority_vote), (K_MEAN, knn.mean_vote)):
        nb = cut_lineage(knn.knn(te, tr, k, "row_id", "x", "row_id", "x", LABEL))
        share = nb.groupBy("query_id").agg(F.avg(F.col("neighbor_label").cast("double")).alias("p"))
        scored = vote(nb).join(share, "query_id").join(te.select(F.col("row_id").alias("query_id"), LABEL), "query_id")
        rows.append(_metrics_row(f"knn{k}", scored))
    return metrics.report_frame(spark, rows)
