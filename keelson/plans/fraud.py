"""The fraud-detection workflow on the transaction / identity CSV files (schema
in FIXTURES.md) as one Spark plan, with the column lists and encoding recipe the
reference uses. Train and test are processed in step in one tagged frame; every
encoding family is one pass (see operators.encode); lineage is cut after each
fitted stage.

Differences on purpose (SURVEY 2.12): codes are int, never int16; the real test
files feed the encoders (as in the reference) but the evaluation uses the
stratified held-out part of train, kept under its own tag, not an overwritten
variable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import clean, encode, joins, linear, metrics, sample, scale
from ..session import cut_lineage
from ..sources import csv as C

# Fixed values of the fraud workflow, as the reference states them.
STRING_COLUMNS = [
    'ProductCD', 'card4', 'card6', 'P_emaildomain', 'R_emaildomain',
    'M1', 'M2', 'M3', 'M4', 'M5', 'M6', 'M7', 'M8', 'M9',
    'id_12', 'id_15', 'id_16', 'id_23', 'id_27', 'id_28', 'id_29',
    'id_30', 'id_31', 'id_33', 'id_34', 'id_35', 'id_36', 'id_37',
    'id_38', 'DeviceType', 'DeviceInfo',
    'id-12', 'id-15', 'id-16', 'id-23', 'id-27', 'id-28', 'id-29',
    'id-30', 'id-31', 'id-33', 'id-34', 'id-35', 'id-36', 'id-37', 'id-38',
]
BASE_COLUMNS = [
    'TransactionID', 'TransactionDT', 'TransactionAmt', 'ProductCD', 'card1', 'card2',
    'card3', 'card4', 'card5', 'card6', 'addr1', 'addr2', 'dist1', 'dist2',
    'P_emaildomain', 'R_emaildomain', 'C1', 'C2', 'C3', 'C4', 'C5', 'C6', 'C7', 'C8',
    'C9', 'C10', 'C11', 'C12', 'C13', 'C14', 'D1', 'D2', 'D3', 'D4', 'D5', 'D6', 'D7',
    'D8', 'D9', 'D10', 'D11', 'D12', 'D13', 'D14', 'D15', 'M1', 'M2', 'M3', 'M4', 'M5',
    'M6', 'M7', 'M8', 'M9',
]
V_SELECTED = [
    1, 3, 4, 6, 8, 11, 13, 14, 17, 20, 23, 26, 27, 30, 36, 37, 40, 41, 44, 47, 48,
    54, 56, 59, 62, 65, 67, 68, 70, 76, 78, 80, 82, 86, 88, 89, 91, 107, 108, 111,
    115, 117, 120, 121, 123, 124, 127, 129, 130, 136, 138, 139, 142, 147, 156, 162,
    165, 160, 166, 178, 176, 173, 182, 187, 203, 205, 207, 215, 169, 171, 175, 180,
    185, 188, 198, 210, 209, 218, 223, 224, 226, 228, 229, 235, 240, 258, 257, 253,
    252, 260, 261, 264, 266, 267, 274, 277, 220, 221, 234, 238, 250, 271, 294, 284,
    285, 286, 291, 297, 303, 305, 307, 309, 310, 320, 281, 283, 289, 296, 301, 314,
]
KEY = 'TransactionID'
LABEL = 'isFraud'
NOT_SHIFTED = ['TransactionAmt', 'TransactionDT']
FREQ_FIRST = ['addr1', 'card1', 'card2', 'card3', 'P_emaildomain']
COMBINED = [('card1', 'addr1'), ('card1_addr1', 'P_emaildomain')]
FREQ_SECOND = ['card1_addr1', 'card1_addr1_P_emaildomain']
GROUP_MAIN = ['TransactionAmt', 'D9', 'D11']
GROUP_UIDS = ['card1', 'card1_addr1', 'card1_addr1_P_emaildomain']
GROUP_AGGS = ['mean', 'std']
DROPPED_FEATURES = ['TransactionDT']
TEST_RATIO = 0.2
SPLIT_SEED = 42
EPOCHS = 10
LEARNING_RATE = 0.01


def transaction_columns() -> list[str]:
    return BASE_COLUMNS + [f"V{x}" for x in V_SELECTED]


def read_typed(spark: SparkSession, path: str, usecols: list[str] | None = None) -> DataFrame:
    """Header-driven typed scan: the file's column order comes from its header; the
    key is long, listed string columns are strings, everything else float32; the
    projection to ``usecols`` is pushed into the scan."""
    header = spark.read.option("header", True).csv(path).columns
    strings = [c for c in header if c in set(STRING_COLUMNS)]
    floats = [c for c in header if c != KEY and c not in set(strings)]
    schema = C.wide_schema([KEY] if KEY in header else [], floats, strings, order=header)
    if LABEL in header:
        schema = T.StructType([T.StructField(f.name, T.IntegerType() if f.name == LABEL else f.dataType, True)
                               for f in schema.fields])
    keep = [c for c in usecols if c in header] if usecols else None
    return C.read_csv(spark, path, schema, keep)


def _float_text(c: str) -> Column:
    """Text of a float column as Python prints it for integral values ('13926.0'),
    'nan' for null; the combined columns are label-encoded afterwards."""
    x = F.col(c)
    if_int = F.concat(x.cast("bigint").cast("string"), F.lit(".0"))
    txt = F.when(x.isNull(), F.lit("nan")).when((x == F.floor(x)) & (F.abs(x) < F.lit(1e15)), if_int) \
           .otherwise(x.cast("string"))
    return txt


def _combine(df: DataFrame, c1: str, c2: str) -> DataFrame:
    name = f"{c1}_{c2}"
    def text(c):
        return _float_text(c) if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)) else \
            F.coalesce(F.col(c).cast("string"), F.lit("nan"))
    df = df.withColumn(name, F.concat(text(c1), F.lit("_"), text(c2)))
    return encode.label_encode(df, [name])


def fraud_features(spark: SparkSession, train_transaction: str, train_identity: str, test_transaction: str,
                   test_identity: str) -> DataFrame:
    """Engineered float features, the label (train only) and a split tag (train / test)."""
    cols = transaction_columns()
    tr = read_typed(spark, train_transaction, cols + [LABEL])
    te = read_typed(spark, test_transaction, cols)
    ti = read_typed(spark, train_identity)
    tei = clean.rename_positional(read_typed(spark, test_identity), ti)   # id-NN spelling -> id_NN
    both = joins.tagged_union({"train": tr.join(ti, KEY, "left"), "test": te.join(tei, KEY, "left")})
    features = [c for c in both.columns if c not in (KEY, LABEL, "split")]
    strings = [c for c in features if isinstance(both.schema[c].dataType, T.StringType)]
    numeric = [c for c in features if c not in set(strings)]
    both = encode.label_encode(both, strings)
    both = cut_lineage(scale.min_shift(both, numeric, exempt=NOT_SHIFTED, fill=-1))
    both = both.withColumn("cents", F.col("TransactionAmt") - F.floor("TransactionAmt").cast("double"))
    both = encode.freq_encode(both, [c for c in FREQ_FIRST if c in both.columns])
    for c1, c2 in COMBINED:
        both = _combine(both, c1, c2)
    both = cut_lineage(encode.freq_encode(both, FREQ_SECOND))
    both = cut_lineage(encode.group_stat_encode(both, [c for c in GROUP_MAIN if c in both.columns], GROUP_UIDS,
                                                GROUP_AGGS, usena=True, fillna=True))
    model_cols = [c for c in both.columns if c not in (KEY, LABEL, "split", *DROPPED_FEATURES)]
    return both.select(KEY, *[F.col(c).cast("float").alias(c) for c in model_cols], LABEL, "split")


def fraud_workflow(spark: SparkSession, train_transaction: str, train_identity: str, test_transaction: str,
                   test_identity: str, epochs: int = EPOCHS, lr: float = LEARNING_RATE) -> tuple[DataFrame, linear.LinearModel]:
    """Features -> stratified split of train -> Adam -> held-out loss and accuracy.
    Returns (one metrics row, fitted model)."""
    feats = fraud_features(spark, train_transaction, train_identity, test_transaction, test_identity)
    model_cols = [c for c in feats.columns if c not in (KEY, LABEL, "split")]
    train = feats.where(F.col("split") == "train").drop("split")
    train = sample.split_stratified(train, KEY, LABEL, seed=SPLIT_SEED, test_ratio=TEST_RATIO, tag="part")
    vec = cut_lineage(train.select(KEY, "part", F.array(*[F.col(c).cast("double") for c in model_cols]).alias("x"),
                                   LABEL))
    model = linear.train_adam(vec.where(F.col("part") == "train"), "x", LABEL, epochs=epochs, lr=lr)
    scored = linear.predict(vec.where(F.col("part") == "test"), "x", model)
    scored = cut_lineage(scored.select(LABEL, "p", "pred"))
    ll = metrics.log_loss(scored, LABEL, "p").first()
    acc = metrics.accuracy(scored, LABEL, "pred").first()
    out = spark.createDataFrame([(ll["n"], float(ll["log_loss"]), float(acc["accuracy"]), len(model_cols))],
                                "n_test long, test_loss double, test_accuracy double, n_features long")
    return out, model
