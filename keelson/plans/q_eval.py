"""Queries for thresholds, evaluation metrics, sampling and splits
(SURVEY 2.2 P6-P7, 2.5 A1, A8-A17, 2.7)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.arrays import argmax
from ..functions.hashing import sql_hash_uint32
from ..functions.scalar import threshold_label
from ..operators import metrics as M
from ..operators import nets as N
from ..operators import sample
from ..operators.linear import fixed_point_scores, linear_score
from ..tables import table
from . import datasets as ds
from .q_models import DENSE_RELU, net_weights, sql_net_ctes
from .registry import b, query, r, sr

OF = ds.ORDER_FEATURES_SQL
SCORED_SQL = f"""{OF}, scored AS (
  SELECT o_orderkey, label, p, (p > 0.5)::INT AS pred FROM (
    SELECT o_orderkey, label, {ds.sql_sigmoid(ds.sql_logit())} AS p FROM order_features))"""


def scored_orders(spark, d):
    vec = ds.order_vectors(spark, d)
    return linear_score(vec, "features", ds.LINEAR_WEIGHTS, ds.LINEAR_BIAS).withColumn("pred", threshold_label("p"))


@query("threshold_label", "P6 F9", sql=f"""
WITH {SCORED_SQL}
SELECT o_orderkey::BIGINT AS o_orderkey, {sr("p")} AS p, pred::BIGINT AS pred FROM scored""")
def q_threshold_label(spark, d):
    return scored_orders(spark, d).select(b("o_orderkey"), r("p"), b("pred"))


@query("close_enough_accuracy", "P7", sql=f"""
WITH {SCORED_SQL}
SELECT count(*)::BIGINT AS n, sum(CASE WHEN abs(p - label) < 0.5 THEN 1 ELSE 0 END)::BIGINT AS n_correct,
       {sr("sum(CASE WHEN abs(p - label) < 0.5 THEN 1 ELSE 0 END)::DOUBLE / count(*)")} AS accuracy FROM scored""")
def q_close_enough(spark, d):
    t = M.close_enough_accuracy(scored_orders(spark, d), "label", "p")
    return t.select(b("n"), b("n_correct"), r("accuracy"))


@query("class_sizes", "A1", sql=f"""
WITH {OF}
SELECT label::BIGINT AS label, count(*)::BIGINT AS n, (min(count(*)) OVER ())::BIGINT AS min_class_size
FROM order_features GROUP BY label""")
def q_class_sizes(spark, d):
    t = M.class_size_report(ds.order_features(spark, d), "label")
    return t.select(b("label"), b("n"), b("min_class_size"))


@query("confusion_matrix", "A8", sql=f"""
WITH {SCORED_SQL}, g AS (SELECT a.c AS y_true, p.c AS y_pred FROM (VALUES (0), (1)) a(c), (VALUES (0), (1)) p(c))
SELECT g.y_true::BIGINT AS y_true, g.y_pred::BIGINT AS y_pred, count(s.o_orderkey)::BIGINT AS n
FROM g LEFT JOIN scored s ON s.label = g.y_true AND s.pred = g.y_pred GROUP BY g.y_true, g.y_pred""")
def q_confusion(spark, d):
    return M.confusion_matrix(scored_orders(spark, d), "label", "pred", classes=[0, 1])


PRF_SQL = """tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn,
  {p} AS precision, {r} AS recall, {f} AS f1"""


@query("binary_prf", "A9", sql=f"""
WITH {SCORED_SQL}, c AS (
  SELECT sum(CASE WHEN label = 1 AND pred = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN label <> 1 AND pred = 1 THEN 1 ELSE 0 END) AS fp,
         sum(CASE WHEN label = 1 AND pred <> 1 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN label <> 1 AND pred <> 1 THEN 1 ELSE 0 END) AS tn
  FROM scored)
SELECT {PRF_SQL.format(p=sr("CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END"),
                       r=sr("CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn) END"),
                       f=sr("CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE (2 * tp)::DOUBLE / (2 * tp + fp + fn) END"))} FROM c""")
def q_binary_prf(spark, d):
    t = M.binary_prf(scored_orders(spark, d), "label", "pred")
    return t.select(b("tp"), b("fp"), b("fn"), b("tn"), r("precision"), r("recall"), r("f1"))


@query("accuracy", "A10", sql=f"""
WITH {SCORED_SQL}
SELECT count(*)::BIGINT AS n, sum(CASE WHEN label = pred THEN 1 ELSE 0 END)::BIGINT AS n_correct,
       {sr("sum(CASE WHEN label = pred THEN 1 ELSE 0 END)::DOUBLE / count(*)")} AS accuracy FROM scored""")
def q_accuracy(spark, d):
    t = M.accuracy(scored_orders(spark, d), "label", "pred")
    return t.select(b("n"), b("n_correct"), r("accuracy"))


ROC_SQL = f"""{SCORED_SQL},
per AS (SELECT p AS threshold, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS tp,
               sum(CASE WHEN label <> 1 THEN 1 ELSE 0 END) AS fp FROM scored GROUP BY p),
cum AS (SELECT threshold, tp, fp, sum(tp) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS ctp,
               sum(fp) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS cfp FROM per),
tot AS (SELECT sum(tp) AS P, sum(fp) AS N FROM per)"""


@query("roc_points", "A11", sql=f"""
WITH {ROC_SQL},
o AS (SELECT *, lead(tp) OVER (ORDER BY threshold DESC) AS ntp, lead(fp) OVER (ORDER BY threshold DESC) AS nfp,
             row_number() OVER (ORDER BY threshold DESC) AS rn FROM cum),
kept AS (SELECT threshold, cfp, ctp FROM o WHERE rn = 1 OR ntp IS NULL OR ntp <> tp OR nfp <> fp
         UNION ALL SELECT 'inf'::DOUBLE, 0, 0)
SELECT CASE WHEN isinf(threshold) THEN threshold ELSE {sr("threshold", 9)} END AS threshold, cfp::BIGINT AS fps,
       ctp::BIGINT AS tps, {sr("cfp::DOUBLE / N")} AS fpr, {sr("ctp::DOUBLE / P")} AS tpr FROM kept, tot""")
def q_roc_points(spark, d):
    t = M.roc_points(scored_orders(spark, d), "label", "p")
    th = F.col("threshold")
    return t.select(F.when(F.isnan(th) | (th == float("inf")), th).otherwise(r("threshold", places=9)).alias("threshold"),
                    b("fps"), b("tps"), r("fpr"), r("tpr"))


@query("roc_auc", "A12", sql=f"""
WITH {ROC_SQL}
SELECT sum(tp)::BIGINT AS n_pos, sum(fp)::BIGINT AS n_neg,
       {sr("sum(fp * (2 * ctp - tp))::DOUBLE / (2.0 * sum(tp) * sum(fp))")} AS auc FROM cum""")
def q_roc_auc(spark, d):
    t = M.roc_auc(scored_orders(spark, d), "label", "p")
    return t.select(b("n_pos"), b("n_neg"), r("auc"))


@query("log_loss", "A13", sql=f"""
WITH {SCORED_SQL}
SELECT count(*)::BIGINT AS n, {sr('''avg(-(label::DOUBLE * CASE WHEN p > 0 THEN greatest(ln(p), -100.0) ELSE -100.0 END
   + (1.0 - label::DOUBLE) * CASE WHEN p < 1 THEN greatest(ln(1.0 - p), -100.0) ELSE -100.0 END))''')} AS log_loss FROM scored""")
def q_log_loss(spark, d):
    t = M.log_loss(scored_orders(spark, d), "label", "p")
    return t.select(b("n"), r("log_loss"))


def image_logits(spark, d):
    """image_id, label, logits of the dense ReLU net over all pixels."""
    im = ds.images(spark, d)
    return N.score_net(im, DENSE_RELU, net_weights(spark, DENSE_RELU)).select("image_id", "logits").join(im.select("image_id", "label"), "image_id")


_NET, _LAST = sql_net_ctes(DENSE_RELU)
LOGITS_SQL = f"""{_NET}, lz AS (SELECT id, list(v ORDER BY j) AS z FROM {_LAST} GROUP BY id),
lg AS (SELECT e.vec_id, e.label, lz.z FROM embeddings e JOIN lz ON lz.id = e.vec_id)"""


@query("cross_entropy", "A14 R5", sql=f"""
WITH {LOGITS_SQL},
rows_ AS (SELECT (row_number() OVER (ORDER BY {sql_hash_uint32("0|0", "vec_id")}, vec_id) - 1) // 64 AS batch_id,
                 list_max(z) + ln(list_reduce(list_prepend(0.0::DOUBLE, list_transform(z, lambda x: exp(x - list_max(z)))), lambda a, x: a + x))
                 - z[label + 1] AS ce FROM lg)
SELECT batch_id::BIGINT AS batch_id, count(*)::BIGINT AS n, {sr("avg(ce)")} AS cross_entropy FROM rows_ GROUP BY batch_id""")
def q_cross_entropy(spark, d):
    lg = sample.minibatch_ids(image_logits(spark, d), "image_id", batch_size=64, seed=0, epoch=0)
    t = M.cross_entropy(lg, "logits", "label", batch="batch_id")
    return t.select(b("batch_id"), b("n"), r("cross_entropy"))


CLASSES_PLUS_EMPTY = list(range(11))


@query("per_class_accuracy", "A15 L3", sql=f"""
WITH {LOGITS_SQL}, pr AS (SELECT label, list_position(z, list_max(z)) - 1 AS pred FROM lg),
st AS (SELECT label, sum(CASE WHEN label = pred THEN 1 ELSE 0 END) AS correct, count(*) AS total FROM pr GROUP BY label)
SELECT c.range::BIGINT AS class, coalesce(st.correct, 0)::BIGINT AS correct, coalesce(st.total, 0)::BIGINT AS total,
       {sr("st.correct::DOUBLE / st.total")} AS accuracy
FROM range(11) c LEFT JOIN st ON st.label = c.range""")
def q_per_class_accuracy(spark, d):
    pr = image_logits(spark, d).withColumn("pred", argmax("logits"))
    t = M.per_class_accuracy(pr, "label", "pred", CLASSES_PLUS_EMPTY)
    return t.select(b("class"), b("correct"), b("total"), r("accuracy"))


@query("macro_prf", "A16", sql=f"""
WITH {LOGITS_SQL}, pr AS (SELECT label, list_position(z, list_max(z)) - 1 AS pred FROM lg),
bt AS (SELECT label AS c, sum(CASE WHEN label = pred THEN 1 ELSE 0 END) AS tp, count(*) AS support FROM pr GROUP BY label),
bp AS (SELECT pred AS c, count(*) AS predicted FROM pr GROUP BY pred),
t AS (SELECT k.range AS c, coalesce(bt.tp, 0) AS tp, coalesce(bp.predicted, 0) - coalesce(bt.tp, 0) AS fp,
             coalesce(bt.support, 0) - coalesce(bt.tp, 0) AS fn
      FROM range(10) k LEFT JOIN bt ON bt.c = k.range LEFT JOIN bp ON bp.c = k.range),
m AS (SELECT c, tp, fp, fn,
             CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END AS precision,
             CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn) END AS recall,
             CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE (2 * tp)::DOUBLE / (2 * tp + fp + fn) END AS f1 FROM t)
SELECT c::BIGINT AS class, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, {sr("precision")} AS precision,
       {sr("recall")} AS recall, {sr("f1")} AS f1, {sr("avg(precision) OVER ()")} AS macro_precision,
       {sr("avg(recall) OVER ()")} AS macro_recall, {sr("avg(f1) OVER ()")} AS macro_f1 FROM m""")
def q_macro_prf(spark, d):
    pr = image_logits(spark, d).withColumn("pred", argmax("logits"))
    t = M.per_class_prf(pr, "label", "pred", list(range(10)))
    w = Window.partitionBy()
    t = t.select("*", F.avg("precision").over(w).alias("macro_precision"), F.avg("recall").over(w).alias("macro_recall"),
                 F.avg("f1").over(w).alias("macro_f1"))
    return t.select(b("class"), b("tp"), b("fp"), b("fn"), r("precision"), r("recall"), r("f1"),
                    r("macro_precision"), r("macro_recall"), r("macro_f1"))


def _sql_fixed(x: str, bits: int) -> str:
    s = float(2 ** bits)
    return f"(round_even(({x}) * {s!r}::DOUBLE, 0) / {s!r}::DOUBLE)"


def _sql_fixed_logit(bits: int) -> str:
    feats = [_sql_fixed(f, bits) for f in ds.FEATURE_SQL]
    w = [float(round(x * 2 ** bits) / 2 ** bits) for x in ds.LINEAR_WEIGHTS]
    bb = float(round(ds.LINEAR_BIAS * 2 ** bits) / 2 ** bits)
    return ds.sql_logit(w, bb, feats)


DRIFT_BITS = (8, 20, 40)


def _variants_sql() -> str:
    arms = [f"SELECT o_orderkey, label, 'plain' AS variant, {ds.sql_sigmoid(ds.sql_logit())} AS p FROM order_features"]
    for bits in DRIFT_BITS:
        arms.append(f"SELECT o_orderkey, label, 'fixed{bits}' AS variant, {ds.sql_sigmoid(_sql_fixed_logit(bits))} AS p "
                    "FROM order_features")
    return "v AS (" + " UNION ALL ".join(arms) + ")"


def _variant_scores(spark, d):
    vec = ds.order_vectors(spark, d)
    v = fixed_point_scores(vec, "features", ds.LINEAR_WEIGHTS, ds.LINEAR_BIAS, DRIFT_BITS)
    return v.withColumn("pred", threshold_label("p"))


@query("model_drift_summary", "A17", sql=f"""
WITH {OF}, {_variants_sql()},
per AS (SELECT variant, count(*) AS n, avg(CASE WHEN label = (p > 0.5)::INT THEN 1.0 ELSE 0.0 END) AS accuracy,
        count(*) FILTER (label = 1 AND p > 0.5) AS tp, count(*) FILTER (label <> 1 AND p > 0.5) AS fp,
        count(*) FILTER (label = 1 AND NOT p > 0.5) AS fn FROM v GROUP BY variant)
SELECT variant, n::BIGINT AS n, {sr("accuracy")} AS accuracy,
       {sr("accuracy - (SELECT accuracy FROM per WHERE variant = 'plain')")} AS drift,
       {sr("abs(accuracy - (SELECT accuracy FROM per WHERE variant = 'plain'))")} AS abs_drift,
       {sr("CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END")} AS "precision",
       {sr("CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn) END")} AS recall,
       {sr("CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE (2 * tp)::DOUBLE / (2 * tp + fp + fn) END")} AS f1 FROM per""")
def q_model_drift(spark, d):
    t = M.model_drift_summary(_variant_scores(spark, d), "variant", "label", "pred", "plain")
    return t.select("variant", b("n"), r("accuracy"), r("drift"), r("abs_drift"), r("precision"), r("recall"), r("f1"))


@query("fixed_point_drift", "M9", sql=f"""
WITH {OF}, {_variants_sql()}, pl AS (SELECT o_orderkey, p AS p0 FROM v WHERE variant = 'plain')
SELECT variant, count(*)::BIGINT AS n, {sr("max(abs(v.p - pl.p0))", 9)} AS max_abs_diff,
       sum(CASE WHEN (v.p > 0.5) <> (pl.p0 > 0.5) THEN 1 ELSE 0 END)::BIGINT AS n_changed
FROM v JOIN pl ON v.o_orderkey = pl.o_orderkey GROUP BY variant""")
def q_fixed_point_drift(spark, d):
    v = _variant_scores(spark, d)
    t = v.groupBy("variant").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("p") - F.col("p_plain"))).alias("max_abs_diff"),
        F.sum((F.col("pred") != threshold_label("p_plain")).cast("long")).alias("n_changed"))
    return t.select("variant", b("n"), r("max_abs_diff", places=9), b("n_changed"))


# ---------------------------------------------------------------- 2.7 sampling

@query("limited_eval", "L2", sql=f"""
WITH {SCORED_SQL}
SELECT o_orderkey::BIGINT AS o_orderkey, {sr("p")} AS p, pred::BIGINT AS pred, label::BIGINT AS label FROM scored
ORDER BY {sql_hash_uint32(0, "o_orderkey")}, o_orderkey LIMIT 100""")
def q_limited_eval(spark, d):
    t = sample.first_n(scored_orders(spark, d), "o_orderkey", 100, seed=0)
    return t.select(b("o_orderkey"), r("p"), b("pred"), b("label"))


@query("argmax_class", "L3", sql="""
SELECT vec_id::BIGINT AS image_id, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS argmax FROM embeddings""")
def q_argmax(spark, d):
    return ds.images(spark, d).select(b("image_id"), b("argmax", argmax("pixels")))


@query("undersample_balance", "R1", sql=f"""
WITH {OF}, rk AS (SELECT o_orderkey, label,
    row_number() OVER (PARTITION BY label ORDER BY {sql_hash_uint32(73, "o_orderkey")}, o_orderkey) AS r,
    min(cnt) OVER () AS m FROM (SELECT *, count(*) OVER (PARTITION BY label) AS cnt FROM order_features))
SELECT o_orderkey::BIGINT AS o_orderkey, label::BIGINT AS label FROM rk WHERE r <= m""")
def q_undersample(spark, d):
    t = sample.undersample_balance(ds.order_features(spark, d).select("o_orderkey", "label"), "label", "o_orderkey", seed=73)
    return t.select(b("o_orderkey"), b("label"))


def _sql_split(src, id_col, seed, ratio, by=None):
    from .q_tabular import sql_split
    return sql_split(src, id_col, seed, ratio, by)


@query("split_exact", "R2", sql=f"""
SELECT o_orderkey::BIGINT AS o_orderkey, split FROM ({_sql_split("orders", "o_orderkey", 42, 0.3)})""")
def q_split_exact(spark, d):
    t = sample.split_exact(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", seed=42, test_ratio=0.3)
    return t.select(b("o_orderkey"), "split")


@query("split_stratified", "R3", sql=f"""
WITH {OF}
SELECT o_orderkey::BIGINT AS o_orderkey, label::BIGINT AS label, split
FROM ({_sql_split("order_features", "o_orderkey", 42, 0.2, by="label")})""")
def q_split_stratified(spark, d):
    t = sample.split_stratified(ds.order_features(spark, d).select("o_orderkey", "label"), "o_orderkey", "label",
                                seed=42, test_ratio=0.2)
    return t.select(b("o_orderkey"), b("label"), "split")


@query("minibatch_ids", "R5", sql=f"""
SELECT vec_id::BIGINT AS image_id, e.range::BIGINT AS epoch,
       ((row_number() OVER (PARTITION BY e.range ORDER BY {sql_hash_uint32(7, "e.range", "vec_id")}, vec_id) - 1) // 64)::BIGINT AS batch_id
FROM embeddings, range(2) e""")
def q_minibatch(spark, d):
    im = ds.images(spark, d).select("image_id")
    parts = [sample.minibatch_ids(im, "image_id", 64, seed=7, epoch=e).withColumn("epoch", F.lit(e))
             for e in range(2)]
    t = parts[0].unionByName(parts[1])
    return t.select(b("image_id"), b("epoch"), b("batch_id"))
