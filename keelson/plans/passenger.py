"""Passenger-table preprocessing (schema in FIXTURES.md) with the values the
reference uses, built from this package's operators.

Differences on purpose (SURVEY 2.12): the cabin letter comes from the row's own
value; the Embarked mode, label codes and one-hot categories are fitted on the
train split and applied to both; the passenger id is kept as the row key
(DataFrame rows have no position) and is not a feature.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import clean, encode, joins

# Fixed values of the passenger preprocessing, as the reference states them.
CABIN_FILL = "N0"
FAMILY_CAP = 6
AGE_BINS = [0, 7, 18, 30, 50, 120]
AGE_LABELS = ["Young Child", "Child", "Young Adult", "Adult", "Senior"]
TITLE_MAP = {
    "Sir": "Mr", "Jonkheer": "Mr", "Countess": "Mrs", "Lady": "Mrs", "Mlle": "Miss", "Ms": "Mrs",
    "Capt": "Other", "Mme": "Mrs", "Don": "Other", "Major": "Other", "Col": "Other", "Dona": "Mrs",
    "Rev": "Other", "Dr": "Other", "Master": "Other",
}
FARE_BINS = [-1, 25, 50, 100, math.inf]
FARE_LABELS = ["0-25", "25-50", "50-100", "100+"]
DROPPED = ["Ticket"]
LABEL_ENCODED = ["Pclass", "Age_Bin", "Fare_bin"]
ONE_HOT = ["Cabin", "Embarked", "Title"]


def preprocess_passengers(train: DataFrame, test: DataFrame, id_col: str = "PassengerId",
                          split_col: str = "split") -> DataFrame:
    """Train and test passengers in one frame tagged by ``split_col``, with the
    engineered columns: Cabin letter, Family_Size (capped), Age_Bin (left-closed),
    Title (mapped), Fare_bin (right-closed), isAlone, Sex as a male flag, label codes,
    one-hot columns and the three interaction features."""
    df = joins.tagged_union({"train": train, "test": test}, tag=split_col)
    df = df.withColumn("Cabin", S.extract_first(F.coalesce(F.col("Cabin"), F.lit(CABIN_FILL)), S.LETTER_RUN))
    df = df.withColumn("Family_Size", S.capped_sum("SibSp", "Parch", FAMILY_CAP))
    df = df.withColumn("Age_Bin", S.bin_left_closed("Age", AGE_BINS, AGE_LABELS)).drop("Age")
    df = df.withColumn("Title", S.replace_mapping(S.extract_first("Name", S.TITLE_BEFORE_DOT), TITLE_MAP)).drop("Name")
    df = df.withColumn("Fare_bin", S.bin_right_closed("Fare", FARE_BINS, FARE_LABELS)).drop("Fare")
    df = df.withColumn("isAlone", S.flag_equals("Family_Size", 0).cast("int"))
    df = df.drop(*DROPPED)
    train_part = df.where(F.col(split_col) == F.lit("train"))
    mode = clean.column_modes(train_part, ["Embarked"])["Embarked"]
    if mode is not None:
        df = df.fillna({"Embarked": mode})
    df = df.withColumn("Sex", S.flag_equals("Sex", "male").cast("int"))
    train_part = df.where(F.col(split_col) == F.lit("train"))
    df = encode.label_encode(df, LABEL_ENCODED, fit_on=train_part)
    for c in ONE_HOT:
        cats = encode.one_hot_categories(train_part, c)
        df = encode.one_hot(df, c, cats, prefix=c)
    return (df.withColumn("Age_Pclass", F.col("Age_Bin") * F.col("Pclass"))
              .withColumn("isAlone_Age", F.col("isAlone") * F.col("Age_Bin"))
              .withColumn("isAlone_Sex", F.col("isAlone") * F.col("Sex")))


# Fixed values of the passenger modelling, as the reference states them.
PASSENGER_TEST_RATIO = 0.2
PASSENGER_SEED = 42
PASSENGER_EPOCHS = 200
PASSENGER_LR = 1.0
PASSENGER_K_MAJORITY = 5
PASSENGER_K_MEAN = 3
FIXED_POINT_BITS = (20, 40)

PASSENGER_COLUMNS = [("PassengerId", "long"), ("Survived", "long"), ("Pclass", "long"), ("Name", "string"),
                     ("Sex", "string"), ("Age", "double"), ("SibSp", "long"), ("Parch", "long"), ("Ticket", "string"),
                     ("Fare", "double"), ("Cabin", "string"), ("Embarked", "string")]


def passenger_workflow(spark, train_csv: str, test_csv: str, epochs: int = PASSENGER_EPOCHS,
                       lr: float = PASSENGER_LR) -> DataFrame:
    """Preprocess -> split the labelled rows -> SMOTE on the train part -> population
    scaling fitted on it -> LR (plus fixed-point variants) and both kNN votes ->
    one metrics row per model."""
    from pyspark.sql import types as T

    from ..functions.arrays import assemble
    from ..operators import knn, linear, metrics, sample, scale
    from ..operators.oversample import smote
    from ..session import cut_lineage
    from ..sources.csv import read_csv

    types = {"long": T.LongType(), "double": T.DoubleType(), "string": T.StringType()}
    schema = T.StructType([T.StructField(c, types[t], True) for c, t in PASSENGER_COLUMNS])
    test_schema = T.StructType([f for f in schema.fields if f.name != "Survived"])
    train = read_csv(spark, train_csv, schema)
    test = read_csv(spark, test_csv, test_schema)
    df = cut_lineage(preprocess_passengers(train, test.withColumn("Survived", F.lit(None).cast("long"))
                                           .select(*train.columns)))
    labelled = df.where(F.col("split") == "train").drop("split")
    feats = [c for c in labelled.columns if c not in ("PassengerId", "Survived")]
    vec = labelled.select("PassengerId", assemble(feats).alias("x"), F.col("Survived").cast("int").alias("y"))
    vec = cut_lineage(sample.split_exact(vec, "PassengerId", seed=PASSENGER_SEED, test_ratio=PASSENGER_TEST_RATIO,
                                         tag="part"))
    tr = smote(vec.where(F.col("part") == "train"), "PassengerId", "x", "y", k=5, seed=PASSENGER_SEED)
    tr = cut_lineage(tr.select(F.col("id").alias("PassengerId"), F.col("vec").alias("x"), F.col("label").cast("int").alias("y")))
    te = vec.where(F.col("part") == "test").select("PassengerId", "x", "y")
    cols = [f"f{j}" for j in range(len(feats))]
    moments = scale.fit_moments(tr.select(*[F.col("x")[j].alias(c) for j, c in enumerate(cols)]), cols,
                                population=True)

    def scaled(d):
        parts = []
        for j, c in enumerate(cols):
            m, s = moments[c]
            parts.append((F.col("x")[j] - F.lit(m or 0.0)) / F.lit(s if s else 1.0))
        return d.select("PassengerId", F.array(*parts).alias("x"), "y")

    tr_s, te_s = cut_lineage(scaled(tr)), cut_lineage(scaled(te))
    model = linear.train_gd(tr_s, "x", "y", epochs=epochs, lr=lr)
    rows = []

    def report(name, scored):
        scored = cut_lineage(scored.select("y", "p", "pred"))
        rows.append((name, metrics.binary_report(scored, "y", "p", "pred")))

    variants = linear.fixed_point_scores(te_s, "x", model.weights, model.bias, FIXED_POINT_BITS)
    variants = cut_lineage(variants.withColumn("pred", (F.col("p") > 0.5).cast("int")))
    for v in ["plain"] + [f"fixed{b}" for b in FIXED_POINT_BITS]:
        report("lr_gd" if v == "plain" else f"lr_gd_{v}", variants.where(F.col("variant") == v))
    for k, vote in ((PASSENGER_K_MAJORITY, knn.majority_vote), (PASSENGER_K_MEAN, knn.mean_vote)):
        nb = cut_lineage(knn.knn(te_s, tr_s, k, "PassengerId", "x", "PassengerId", "x", "y"))
        share = nb.groupBy("query_id").agg(F.avg(F.col("neighbor_label").cast("double")).alias("p"))
        scored = vote(nb).join(share, "query_id").join(te_s.select(F.col("PassengerId").alias("query_id"), "y"),
                                                        "query_id")
        report(f"knn{k}", scored)
    return metrics.report_frame(spark, rows)
