"""End-to-end pipelines, each one query (diabetes and fraud style with an oracle of the whole,
passenger style rows-only; every step also has its own oracle-checked query). Splits come first, so every fitted state
(scales, codes, categories, oversampling) is fitted on train only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.arrays import assemble
from ..functions.hashing import sql_hash_uint32
from ..operators import clean, encode, joins, knn, linear, metrics, sample, scale
from ..operators.oversample import smote
from ..session import cut_lineage, cut_packed, release
from ..tables import table
from . import datasets as ds
from .q_models import sql_adam_weights, sql_gd_weights
from .q_tabular import sql_split
from .registry import b, query, r, sr


def _evaluate(scored: DataFrame, model: str, y: str = "label", p: str = "p", pred: str = "pred") -> DataFrame:
    """One metrics row. The scored rows are materialised first, so the model (e.g. a
    kNN pass) runs once, not once per metric."""
    scored = cut_lineage(scored.select(y, p, pred))
    return metrics.report_frame(scored.sparkSession, [(model, metrics.binary_report(scored, y, p, pred))])


def _report(df: DataFrame) -> DataFrame:
    return df.select("model", b("n"), *[r(c) for c in ("accuracy", "precision", "recall", "f1", "auc", "log_loss")])


NUMERIC = ["o_totalprice", "n_lines", "sum_qty", "avg_disc", "avg_tax", "n_returned", "max_price"]


def diabetes_style(spark: SparkSession, d: str, epochs: int = 200, lr: float = 0.1) -> DataFrame:
    """drop nulls -> undersample classes -> exact split -> standardise (sample std,
    fit on train) -> LR by gradient descent -> threshold metrics, ROC AUC, log loss."""
    # balancing and splitting read their input several times: each gets it from a checkpoint
    df = cut_lineage(clean.drop_null_rows(ds.order_features(spark, d).select("o_orderkey", *NUMERIC, "label")))
    df = cut_lineage(sample.undersample_balance(df, "label", "o_orderkey", seed=73))
    df = cut_lineage(sample.split_exact(df, "o_orderkey", seed=42, test_ratio=0.3))
    train = df.where(F.col("split") == "train")
    df = scale.standardize_sample(df, NUMERIC, fit_on=train)
    vec = df.select("o_orderkey", "split", assemble(NUMERIC).alias("features"), "label")
    model = linear.train_gd(vec.where(F.col("split") == "train"), "features", "label", epochs=epochs, lr=lr)
    scored = linear.predict(vec.where(F.col("split") == "test"), "features", model)
    return _evaluate(scored, "lr_gd")


def _sql_report(model: str, nf: int, epochs: int, held_out: str) -> str:
    """The last CTEs and the metrics row: rows z(x0 ..., y) that satisfy ``held_out`` scored by the last weights of W."""
    terms = " + ".join(f"x{j} * w{j}" for j in range(nf))
    bce = ("-(y * CASE WHEN p > 0 THEN greatest(ln(p), -100.0) ELSE -100.0 END"
           " + (1.0 - y) * CASE WHEN p < 1 THEN greatest(ln(1.0 - p), -100.0) ELSE -100.0 END)")
    div = lambda a, c: sr(f"CASE WHEN {c} = 0 THEN 0.0 ELSE ({a})::DOUBLE / ({c}) END")
    return f"""sc AS MATERIALIZED (SELECT y, 1.0::DOUBLE / (1.0::DOUBLE + exp(-((0.0::DOUBLE + {terms}) + b))) AS p
                    FROM z, W WHERE {held_out} AND epoch = {epochs}),
k AS (SELECT count(*) AS n, count(*) FILTER (y = 1 AND p > 0.5) AS tp, count(*) FILTER (y <> 1 AND p > 0.5) AS fp,
             count(*) FILTER (y = 1 AND NOT p > 0.5) AS fn, count(*) FILTER (y <> 1 AND NOT p > 0.5) AS tn, avg({bce}) AS ll FROM sc),
g AS (SELECT p, count(*) FILTER (y = 1) AS tp, count(*) FILTER (y <> 1) AS fp FROM sc GROUP BY p),
cum AS (SELECT *, sum(tp) OVER (ORDER BY p DESC) AS ctp FROM g),
a AS (SELECT sum(fp * (2 * ctp - tp))::DOUBLE / (2.0 * sum(tp) * sum(fp)) AS auc FROM cum)
SELECT '{model}' AS model, n::BIGINT AS n, {div("tp + tn", "n")} AS accuracy, {div("tp", "tp + fp")} AS "precision",
       {div("tp", "tp + fn")} AS recall, {div("2 * tp", "2 * tp + fp + fn")} AS f1, {sr("auc")} AS auc, {sr("ll")} AS log_loss
FROM k, a"""


def _sql_diabetes(epochs: int = 200, lr: float = 0.1) -> str:
    nf = len(NUMERIC)
    z = ", ".join(f"({c}::DOUBLE - m{j}) / s{j} AS x{j}" for j, c in enumerate(NUMERIC))
    moments = ", ".join(f"avg({c}::DOUBLE) AS m{j}, stddev_samp({c}::DOUBLE) AS s{j}" for j, c in enumerate(NUMERIC))
    return f"""
WITH RECURSIVE {ds.ORDER_FEATURES_SQL},
c0 AS (SELECT o_orderkey, {", ".join(NUMERIC)}, label, count(*) OVER (PARTITION BY label) AS cnt FROM order_features
       WHERE {" AND ".join(f"{c} IS NOT NULL" for c in NUMERIC)}),
u0 AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {sql_hash_uint32(73, "o_orderkey")}, o_orderkey) AS rk,
              min(cnt) OVER () AS least_cnt FROM c0),
u AS (SELECT * FROM u0 WHERE rk <= least_cnt),
s AS MATERIALIZED ({sql_split("u", "o_orderkey", 42, 0.3)}),
mo AS (SELECT {moments} FROM s WHERE split = 'train'),
z AS MATERIALIZED (SELECT split, label::DOUBLE AS y, {z} FROM s, mo),
X AS MATERIALIZED (SELECT * FROM z WHERE split = 'train'),
{sql_gd_weights(nf, epochs, lr)},
{_sql_report("lr_gd", nf, epochs, "split = 'test'")}"""


@query("pipeline_diabetes", "P1 R1 A5 R2 M1 M3 A8-A13", sql=_sql_diabetes())
def q_pipeline_diabetes(spark, d):
    return _report(diabetes_style(spark, d))


QTY_EDGES = [0, 50, 100, 150, 200, 400]
DISC_EDGES = [float("-inf"), 0.02, 0.04, 0.06, 0.08, float("inf")]


def passenger_style(spark: SparkSession, d: str, epochs: int = 200, lr: float = 1.0, k: int = 5) -> DataFrame:
    """Feature engineering of the passenger script on orders + customers, then
    split -> SMOTE on train -> population scaling -> LR and kNN, both evaluated."""
    of = ds.order_features(spark, d)
    cust = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    df = joins.left_join(of, cust, "o_custkey", "c_custkey")
    titles = table(spark, d, "documents").select(F.col("doc_id").alias("o_custkey"), S.extract_first("text", S.TITLE_BEFORE_DOT).alias("title"))
    df = joins.left_join(df, titles, "o_custkey")
    df = df.withColumn("name_word", S.extract_first("c_name", S.LETTER_RUN)).withColumn("cents", S.fractional_part("o_totalprice"))
    df = df.withColumn("family", S.capped_sum("n_lines", "n_returned", 6))
    df = df.withColumn("qty_bin", S.bin_left_closed("sum_qty", QTY_EDGES, ["q0", "q1", "q2", "q3", "q4"]))
    df = df.withColumn("disc_bin", S.bin_right_closed("avg_disc", DISC_EDGES, ["d0", "d1", "d2", "d3", "d4"]))
    df = df.withColumn("is_open", S.flag_equals("o_orderstatus", "O").cast("int"))
    df = df.withColumn("alone", S.flag_equals("family", 0).cast("int"))
    df = cut_packed(df.drop("o_custkey", "o_orderpriority", "c_name"))  # not read again
    release(spark)
    df = cut_packed(sample.split_exact(df, "o_orderkey", seed=42, test_ratio=0.2))
    release(spark)
    train = df.where(F.col("split") == "train")
    df = clean.fill_constant(df, {"sum_qty": 0.0, "avg_disc": 0.0, "avg_tax": 0.0, "max_price": 0.0})
    df = clean.fill_mode(df, ["n_lines", "family"], fit_on=train)
    df = encode.label_encode(df, ["qty_bin", "disc_bin", "c_mktsegment", "name_word", "title"], fit_on=train, suffix="_code")
    df = encode.combine_encode(df, "c_mktsegment", "o_orderstatus", fit_on=train)
    cats = encode.one_hot_categories(train, "o_orderstatus")
    df = encode.one_hot(df, "o_orderstatus", cats, prefix="status")
    df = df.withColumn("open_price", S.interaction("is_open", "o_totalprice")) \
           .withColumn("family_disc", S.interaction("family", "avg_disc"))
    feats = ["o_totalprice", "n_lines", "sum_qty", "avg_disc", "c_acctbal", "family", "is_open", "alone",
             "qty_bin_code", "disc_bin_code", "c_mktsegment_code", "name_word_code", "title_code", "c_mktsegment_o_orderstatus", "cents",
             "open_price", "family_disc"] + \
            [f"status_{c}" for c in cats]
    vec = cut_packed(df.select("o_orderkey", "split", assemble(feats).alias("features"), "label"))
    del df, train
    release(spark)
    te = cut_packed(vec.where(F.col("split") == "test").select(F.col("o_orderkey").alias("id"), F.col("features").alias("vec"), "label"))
    tr = cut_packed(smote(vec.where(F.col("split") == "train"), "o_orderkey", "features", "label", k=5, seed=42))  # read for its moments and its rows
    del vec
    release(spark)
    moments = scale.fit_moments(_unpack(tr, len(feats)), [f"f{j}" for j in range(len(feats))], population=True)
    tr_s = _scale_vec(tr, moments, len(feats))
    te_s = _scale_vec(te, moments, len(feats))
    model = linear.train_gd(tr_s, "vec", "label", epochs=epochs, lr=lr)
    lr_eval = _evaluate(linear.predict(te_s, "vec", model), "lr_gd")
    nb = cut_packed(knn.knn(te_s, tr_s, k, "id", "vec", "id", "vec", "label"))
    del tr, tr_s
    release(spark)
    votes = knn.majority_vote(nb).withColumnRenamed("query_id", "id")
    share = nb.groupBy("query_id").agg(F.avg(F.col("neighbor_label").cast("double")).alias("p")) \
              .withColumnRenamed("query_id", "id")
    knn_scored = votes.join(share, "id").join(te_s.select("id", "label"), "id")
    return lr_eval.unionByName(_evaluate(knn_scored, f"knn{k}"))


def _unpack(df: DataFrame, n: int) -> DataFrame:
    return df.select(*[F.col("vec")[j].alias(f"f{j}") for j in range(n)])


def _scale_vec(df: DataFrame, moments: dict, n: int) -> DataFrame:
    parts = []
    for j in range(n):
        m, s = moments[f"f{j}"]
        s = 1.0 if not s else s
        parts.append((F.col("vec")[j] - F.lit(m)) / F.lit(s))
    return df.select("id", F.array(*parts).alias("vec"), "label")


@query("pipeline_passenger", "F1-F8 N1 N2 E2 E3 E4 R4 A6 R2 M1 M4")
def q_pipeline_passenger(spark, d):
    return _report(passenger_style(spark, d))


def fraud_style(spark: SparkSession, d: str, epochs: int = 10, lr: float = 0.01) -> DataFrame:
    """Transactions (orders + line aggregates) left-joined with an identity table
    (customers, renamed by position), train and test processed in step through a
    tagged union: label codes, min shift, cents, combined codes, frequency and
    group-statistic encodings; float features; stratified split; Adam; metrics."""
    of = ds.order_features(spark, d).drop("o_orderpriority")
    ident = clean.rename_positional(
        table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
        ["o_custkey", "id_name", "id_nation", "id_balance", "id_segment"])
    df = cut_lineage(joins.left_join(of, ident, "o_custkey").drop("id_name"))  # the split reads it several times
    s = cut_lineage(sample.split_exact(df, "o_orderkey", seed=7, test_ratio=0.25))
    both = joins.tagged_union({"train": joins.split_back(s, "train"), "test": joins.split_back(s, "test")})
    both = encode.label_encode(both, ["o_orderstatus", "id_segment"])
    both = scale.min_shift(both, ["n_lines", "sum_qty", "avg_disc", "avg_tax", "n_returned", "max_price", "id_balance"],
                           exempt=["o_totalprice"])
    both = cut_lineage(both.withColumn("cents", S.fractional_part("o_totalprice")))
    both = encode.combine_encode(both, "id_nation", "id_segment")
    both = cut_lineage(encode.freq_encode(both, ["id_nation", "n_lines"]))
    both = encode.group_stat_encode(both, ["o_totalprice", "avg_disc"], ["o_custkey"], ["mean", "std"])
    feats = ["o_totalprice", "n_lines", "sum_qty", "avg_disc", "avg_tax", "n_returned", "max_price", "id_balance",
             "o_orderstatus", "id_segment", "cents", "id_nation_id_segment", "id_nation_FE", "n_lines_FE",
             "o_totalprice_o_custkey_mean", "o_totalprice_o_custkey_std", "avg_disc_o_custkey_mean",
             "avg_disc_o_custkey_std"]
    both = clean.cast_columns(both, feats, "float")
    train = cut_lineage(joins.split_back(both, "train"))
    train = sample.split_stratified(train, "o_orderkey", "label", seed=42, test_ratio=0.2, tag="part")
    vec = train.select("o_orderkey", "part", assemble([F.col(c) / F.lit(1000.0) if c in ("o_totalprice", "max_price",
                       "o_totalprice_o_custkey_mean", "o_totalprice_o_custkey_std", "id_balance") else F.col(c)
                       for c in feats]).alias("features"), "label")
    model = linear.train_adam(vec.where(F.col("part") == "train"), "features", "label", epochs=epochs, lr=lr)
    scored = linear.predict(vec.where(F.col("part") == "test"), "features", model)
    return _evaluate(scored, "lr_adam")


def _sql_fraud(epochs: int = 10, lr: float = 0.01) -> str:
    shifted = ["n_lines", "sum_qty", "avg_disc", "avg_tax", "n_returned", "max_price", "id_balance"]
    code = lambda src, c: f"(SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT {c} AS v FROM {src} WHERE {c} IS NOT NULL))"
    feats = ["o_totalprice", *shifted, "o_orderstatus", "id_segment", "cents", "combined", "id_nation_FE", "n_lines_FE",
             "price_mean", "price_std", "disc_mean", "disc_std"]
    thousands = {"o_totalprice", "max_price", "price_mean", "price_std", "id_balance"}
    xs = ", ".join(f"{c}::FLOAT::DOUBLE{' / 1000.0::DOUBLE' if c in thousands else ''} AS x{j}" for j, c in enumerate(feats))
    return f"""
WITH RECURSIVE {ds.ORDER_FEATURES_SQL},
j AS (SELECT o.*, c.c_nationkey AS id_nation, c.c_acctbal AS id_balance, c.c_mktsegment AS id_segment
      FROM order_features o LEFT JOIN customer c ON o.o_custkey = c.c_custkey),
s AS MATERIALIZED ({sql_split("j", "o_orderkey", 7, 0.25)}),
e AS MATERIALIZED (SELECT s.o_orderkey, s.o_custkey, s.split, s.label, s.o_totalprice, s.o_totalprice - floor(s.o_totalprice) AS cents, s.id_nation,
        coalesce(st.code, -1) AS o_orderstatus, coalesce(sg.code, -1) AS id_segment,
        {", ".join(f"coalesce(s.{c}::DOUBLE - min(s.{c}::DOUBLE) OVER (), -1.0) AS {c}" for c in shifted)}
      FROM s LEFT JOIN {code("s", "o_orderstatus")} st ON st.v = s.o_orderstatus LEFT JOIN {code("s", "id_segment")} sg ON sg.v = s.id_segment),
cb AS MATERIALIZED (SELECT *, concat(coalesce(id_nation::VARCHAR, 'nan'), '_', id_segment::VARCHAR) AS cbt FROM e),
fn AS (SELECT id_nation AS v, count(*) / (SELECT count(id_nation) FROM e) AS f FROM e WHERE id_nation IS NOT NULL GROUP BY id_nation),
fl AS (SELECT n_lines AS v, count(*) / (SELECT count(n_lines) FROM e) AS f FROM e WHERE n_lines IS NOT NULL GROUP BY n_lines),
gs AS (SELECT o_custkey, avg(o_totalprice) AS price_mean, stddev_samp(o_totalprice) AS price_std, avg(avg_disc) AS disc_mean,
              stddev_samp(avg_disc) AS disc_std FROM e GROUP BY o_custkey),
h AS (SELECT cb.* EXCLUDE (cbt), cc.code AS combined, CASE WHEN cb.id_nation = -1 THEN -1.0 ELSE fn.f END AS id_nation_FE,
             CASE WHEN cb.n_lines = -1 THEN -1.0 ELSE fl.f END AS n_lines_FE, coalesce(gs.price_mean, -1.0) AS price_mean,
             coalesce(gs.price_std, -1.0) AS price_std, coalesce(gs.disc_mean, -1.0) AS disc_mean, coalesce(gs.disc_std, -1.0) AS disc_std
      FROM cb LEFT JOIN {code("cb", "cbt")} cc ON cc.v = cb.cbt LEFT JOIN fn ON fn.v = cb.id_nation LEFT JOIN fl ON fl.v = cb.n_lines
      LEFT JOIN gs USING (o_custkey)),
tr AS (SELECT * EXCLUDE (split) FROM h WHERE split = 'train'),
z AS MATERIALIZED (SELECT split AS part, label::DOUBLE AS y, {xs} FROM ({sql_split("tr", "o_orderkey", 42, 0.2, "label")})),
X AS MATERIALIZED (SELECT * FROM z WHERE part = 'train'),
{sql_adam_weights(len(feats), epochs, lr)},
{_sql_report("lr_adam", len(feats), epochs, "part = 'test'")}"""


@query("pipeline_fraud", "J1 P4 E1 A7 F3 F4 A2 A3 P5 R3 M2 U1", sql=_sql_fraud())
def q_pipeline_fraud(spark, d):
    return _report(fraud_style(spark, d))
