"""Queries for scans, projections, null handling, encoders, scaling, joins and
scalar feature functions (SURVEY 2.1-2.4, 2.8-2.10)."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import array_sum, as_double_array
from ..functions import scalar as S
from ..functions.hashing import sql_hash_uint32, sql_hash_uniform
from ..operators import clean, encode, joins, scale
from ..operators.sample import split_exact
from ..session import scratch_path
from ..sources import csv as csvsrc
from ..sources.images import pixel_normalize, scan_images
from ..sources.synthetic import separable_rows
from ..sources.weights import read_weights, write_weights
from ..tables import table
from . import datasets as ds
from .registry import b, long_form, query, r, sr

OF = ds.ORDER_FEATURES_SQL


def sql_split(src: str, id_col: str, seed, ratio: float, by: str | None = None) -> str:
    part = f"PARTITION BY {by} " if by else ""
    h = sql_hash_uint32(seed, id_col)
    return (f"SELECT *, CASE WHEN row_number() OVER ({part}ORDER BY {h}, {id_col}) <= "
            f"floor(count(*) OVER ({part}) * {ratio!r}::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM {src}")


# ---------------------------------------------------------------- 2.1 sources

@query("scan_csv", "S1", sql="""
SELECT o_orderkey::BIGINT AS o_orderkey, o_custkey::BIGINT AS o_custkey, o_orderstatus, floor(o_totalprice * 1e2 + 0.5) / 1e2 AS o_totalprice, o_orderpriority
FROM orders""")
def scan_csv(spark, d):
    path = scratch_path(spark, f"orders-csv-{uuid.uuid4().hex}")
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    orders = table(spark, d, "orders").select(*cols)
    csvsrc.write_csv(orders, path)
    df = csvsrc.read_csv(spark, path, T.StructType([T.StructField(f.name, f.dataType) for f in orders.schema.fields]))
    return df.select(b("o_orderkey"), b("o_custkey"), "o_orderstatus", r("o_totalprice", places=2), "o_orderpriority")


CUSTOMER_CSV_SCHEMA_ORDER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query("scan_csv_pruned", "S2 S3", sql="""
SELECT c_custkey::BIGINT AS c_custkey, c_acctbal::FLOAT::DOUBLE AS c_acctbal, c_mktsegment FROM customer""")
def scan_csv_pruned(spark, d):
    path = scratch_path(spark, f"customer-csv-{uuid.uuid4().hex}")
    csvsrc.write_csv(table(spark, d, "customer"), path)
    schema = csvsrc.wide_schema(key_cols=["c_custkey"], float_cols=["c_nationkey", "c_acctbal", "c_mktsegment"],
                                string_cols=["c_name", "c_mktsegment"], order=CUSTOMER_CSV_SCHEMA_ORDER)
    df = csvsrc.read_csv(spark, path, schema, columns=["c_custkey", "c_acctbal", "c_mktsegment"])
    return df.select(b("c_custkey"), F.col("c_acctbal").cast("double").alias("c_acctbal"), "c_mktsegment")


@query("scan_images", "S4", sql=f"""
SELECT vec_id::BIGINT AS image_id, label::BIGINT AS label, len(embedding)::BIGINT AS n_pixels,
       {sr("list_reduce(list_prepend(0.0::DOUBLE, list_transform(embedding, lambda x: x::DOUBLE)), lambda a, x: a + x)")} AS pixel_sum
FROM embeddings""")
def q_scan_images(spark, d):
    df = scan_images(spark, f"{d}/embeddings.parquet", "vec_id", "embedding", "label", ds.IMAGE_H, ds.IMAGE_W)
    return df.select(b("image_id"), b("label"), b("n_pixels", F.size("pixels")),
                     r("pixel_sum", array_sum(as_double_array("pixels"))))


@query("pixel_normalize", "S5", sql=f"""
SELECT vec_id::BIGINT AS image_id, (i - 1)::BIGINT AS pos,
       {sr("(v::DOUBLE * 1.0::DOUBLE - 0.1307::DOUBLE) / 0.3081::DOUBLE")} AS value
FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)""")
def q_pixel_normalize(spark, d):
    return long_form(pixel_normalize(ds.images(spark, d), "pixels"), ["image_id"], "pixels")


@query("weights_roundtrip", "S6", sql=f"""
SELECT 'centroid' AS layer, label::BIGINT AS out_idx, (i - 1)::BIGINT AS in_idx, {sr("avg(v::DOUBLE)")} AS w
FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)
GROUP BY label, i""")
def weights_roundtrip(spark, d):
    px = ds.images(spark, d).select("label", F.posexplode("pixels").alias("pos", "v"))
    w = px.groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("w")).select(
        F.lit("centroid").alias("layer"), F.col("label").cast("int").alias("out_idx"),
        F.col("pos").cast("int").alias("in_idx"), "w")
    path = scratch_path(spark, f"weights-{uuid.uuid4().hex}")
    write_weights(w, path)
    back = read_weights(spark, path)
    return back.select("layer", b("out_idx"), b("in_idx"), r("w"))


def _sql_normal(seed, key, k):
    u1 = f"(1.0::DOUBLE - {sql_hash_uniform(seed, key, str(2 * k))})"
    u2 = sql_hash_uniform(seed, key, str(2 * k + 1))
    return f"(sqrt(-2.0::DOUBLE * ln({u1})) * cos({2 * math.pi!r}::DOUBLE * {u2}))"


@query("synthetic_separable", "S7", sql=f"""
SELECT row_id, {sr("x0")} AS x0, {sr("x1")} AS x1, (x0 >= x1)::BIGINT AS label FROM (
  SELECT o_orderkey::BIGINT AS row_id, {_sql_normal(0, "o_orderkey", 0)} AS x0, {_sql_normal(0, "o_orderkey", 1)} AS x1
  FROM orders)""")
def synthetic_separable(spark, d):
    df = separable_rows(table(spark, d, "orders"), "o_orderkey", seed=0)
    return df.select(b("row_id"), r("x0"), r("x1"), b("label"))


# ---------------------------------------------------------------- 2.2 projections

@query("drop_null_rows", "P1", sql=f"""
WITH {OF}
SELECT o_orderkey::BIGINT AS o_orderkey, o_custkey::BIGINT AS o_custkey, o_orderstatus, n_lines::BIGINT AS n_lines,
       {sr("sum_qty")} AS sum_qty, {sr("avg_disc")} AS avg_disc, {sr("avg_tax")} AS avg_tax,
       n_returned::BIGINT AS n_returned, {sr("max_price", 2)} AS max_price, label::BIGINT AS label
FROM order_features
WHERE o_orderkey IS NOT NULL AND o_custkey IS NOT NULL AND o_orderstatus IS NOT NULL AND o_totalprice IS NOT NULL
  AND o_orderpriority IS NOT NULL AND n_lines IS NOT NULL AND sum_qty IS NOT NULL AND avg_disc IS NOT NULL
  AND avg_tax IS NOT NULL AND n_returned IS NOT NULL AND max_price IS NOT NULL""")
def drop_null_rows(spark, d):
    df = clean.drop_null_rows(ds.order_features(spark, d))
    return df.select(b("o_orderkey"), b("o_custkey"), "o_orderstatus", b("n_lines"), r("sum_qty"), r("avg_disc"),
                     r("avg_tax"), b("n_returned"), r("max_price", places=2), b("label"))


PROJECT_REMOVE = ["o_custkey", "o_orderstatus", "o_orderpriority"]


@query("project_reorder", "P2 P3", sql=f"""
WITH {OF}
SELECT {sr("avg_disc")} AS avg_disc, {sr("avg_tax")} AS avg_tax, label::BIGINT AS label, {sr("max_price", 2)} AS max_price,
       n_lines::DOUBLE AS n_lines, n_returned::DOUBLE AS n_returned, o_orderkey::BIGINT AS o_orderkey,
       {sr("o_totalprice", 2)} AS o_totalprice, {sr("sum_qty")} AS sum_qty
FROM order_features""")
def project_reorder(spark, d):
    df = clean.drop_columns(ds.order_features(spark, d), PROJECT_REMOVE)
    keep = sorted(c for c in df.columns if c not in PROJECT_REMOVE)
    df = clean.select_ordered(df, keep)
    ints = {"label", "o_orderkey"}
    counts = {"n_lines", "n_returned"}           # nullable counts: DOUBLE on both sides
    two = {"max_price", "o_totalprice"}
    return df.select(*[b(c) if c in ints else F.col(c).cast("double").alias(c) if c in counts
                       else r(c, places=2 if c in two else 6) for c in df.columns])


CUSTOMER_HEAD = ["c_custkey", "c_name", "c_nationkey", "c_acctbal"]


@query("rename_positional", "P4", sql="""
SELECT s_suppkey::BIGINT AS c_custkey, s_name AS c_name, s_nationkey::BIGINT AS c_nationkey,
       floor(s_acctbal * 1e2 + 0.5) / 1e2 AS c_acctbal FROM supplier""")
def rename_positional(spark, d):
    like = table(spark, d, "customer").select(*CUSTOMER_HEAD)
    df = clean.rename_positional(table(spark, d, "supplier"), like)
    return df.select(b("c_custkey"), "c_name", b("c_nationkey"), r("c_acctbal", places=2))


CAST_COLS = ["o_totalprice", "sum_qty", "avg_disc", "max_price"]


@query("cast_features", "P5", sql=f"""
WITH {OF}
SELECT o_orderkey::BIGINT AS o_orderkey, o_totalprice::FLOAT AS o_totalprice, sum_qty::FLOAT AS sum_qty,
       avg_disc::FLOAT AS avg_disc, max_price::FLOAT AS max_price FROM order_features""")
def cast_features(spark, d):
    df = clean.cast_columns(ds.order_features(spark, d).select("o_orderkey", *CAST_COLS), CAST_COLS, "float")
    return df.select(b("o_orderkey"), *CAST_COLS)


@query("flag_columns", "P8", sql=f"""
WITH {OF}
SELECT o_orderkey::BIGINT AS o_orderkey, (o_orderstatus IS NOT DISTINCT FROM 'O')::BIGINT AS is_open,
       (n_lines IS NOT DISTINCT FROM 1)::BIGINT AS single_line FROM order_features""")
def flag_columns(spark, d):
    df = ds.order_features(spark, d)
    return df.select(b("o_orderkey"), b("is_open", S.flag_equals("o_orderstatus", "O")),
                     b("single_line", S.flag_equals("n_lines", 1)))


@query("shape_report", "P9", sql=f"""
WITH {OF}, s AS ({sql_split("order_features", "o_orderkey", 42, 0.3)})
SELECT split, count(*)::BIGINT AS n_rows, 13::BIGINT AS n_cols FROM s GROUP BY split""")
def shape_report(spark, d):
    df = split_exact(ds.order_features(spark, d), "o_orderkey", seed=42, test_ratio=0.3)
    return clean.shape_report(df, "split")


# ---------------------------------------------------------------- 2.3 nulls

@query("fill_constant", "N1", sql=f"""
WITH {OF}
SELECT o_orderkey::BIGINT AS o_orderkey, coalesce(n_lines, 0)::BIGINT AS n_lines, {sr("coalesce(sum_qty, 0.0)")} AS sum_qty,
       {sr("coalesce(avg_disc, -1.0)")} AS avg_disc, coalesce(n_returned, 0)::BIGINT AS n_returned FROM order_features""")
def fill_constant(spark, d):
    df = clean.fill_constant(ds.order_features(spark, d), {"n_lines": 0, "sum_qty": 0.0, "avg_disc": -1.0, "n_returned": 0})
    return df.select(b("o_orderkey"), b("n_lines"), r("sum_qty"), r("avg_disc"), b("n_returned"))


@query("fill_mode", "N2", sql=f"""
WITH {OF}, m AS (SELECT n_lines AS v FROM order_features WHERE n_lines IS NOT NULL GROUP BY n_lines
                 ORDER BY count(*) DESC, n_lines ASC LIMIT 1),
ms AS (SELECT o_orderstatus AS v FROM order_features WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus
       ORDER BY count(*) DESC, o_orderstatus ASC LIMIT 1)
SELECT o_orderkey::BIGINT AS o_orderkey, coalesce(n_lines, (SELECT v FROM m))::BIGINT AS n_lines,
       coalesce(o_orderstatus, (SELECT v FROM ms)) AS o_orderstatus FROM order_features""")
def fill_mode(spark, d):
    df = clean.fill_mode(ds.order_features(spark, d).select("o_orderkey", "n_lines", "o_orderstatus"),
                         ["n_lines", "o_orderstatus"])
    return df.select(b("o_orderkey"), b("n_lines"), "o_orderstatus")


# ---------------------------------------------------------------- 2.10 encoders

DOC_LABELS_SQL = """dl AS (SELECT d.doc_id, d.lang, d.source, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def _doc_labels(spark, d):
    lab = table(spark, d, "labels").select("doc_id", "quality")
    return table(spark, d, "documents").select("doc_id", "lang", "source").join(lab, "doc_id", "left")


def _sql_codes(src: str, col: str) -> str:
    return (f"(SELECT {col} AS k, row_number() OVER (ORDER BY {col}) - 1 AS code "
            f"FROM (SELECT DISTINCT {col} FROM {src} WHERE {col} IS NOT NULL))")


@query("label_encode", "E1", sql=f"""
WITH {DOC_LABELS_SQL}
SELECT dl.doc_id::BIGINT AS doc_id, coalesce(a.code, -1)::BIGINT AS lang_code, coalesce(s.code, -1)::BIGINT AS source_code,
       coalesce(q.code, -1)::BIGINT AS quality_code
FROM dl LEFT JOIN {_sql_codes("dl", "lang")} a ON dl.lang = a.k LEFT JOIN {_sql_codes("dl", "source")} s ON dl.source = s.k
        LEFT JOIN {_sql_codes("dl", "quality")} q ON dl.quality = q.k""")
def label_encode(spark, d):
    df = encode.label_encode(_doc_labels(spark, d), ["lang", "source", "quality"], suffix="_code")
    return df.select(b("doc_id"), b("lang_code"), b("source_code"), b("quality_code"))


@query("label_encode_fit_apply", "E2", sql=f"""
WITH s AS ({sql_split("documents", "doc_id", 42, 0.3)}), tr AS (SELECT * FROM s WHERE split = 'train')
SELECT s.doc_id::BIGINT AS doc_id, s.split, coalesce(a.code, -1)::BIGINT AS source_code, coalesce(g.code, -1)::BIGINT AS lang_code
FROM s LEFT JOIN {_sql_codes("tr", "source")} a ON s.source = a.k LEFT JOIN {_sql_codes("tr", "lang")} g ON s.lang = g.k""")
def label_encode_fit_apply(spark, d):
    docs = split_exact(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id", 42, 0.3)
    train = docs.where(F.col("split") == "train")
    df = encode.label_encode(docs, ["source", "lang"], fit_on=train, suffix="_code")
    return df.select(b("doc_id"), "split", b("source_code"), b("lang_code"))


SEGMENTS_AT_SF001 = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("one_hot", "E3", sql=f"""
WITH s AS ({sql_split("customer", "c_custkey", 42, 0.3)})
SELECT c_custkey::BIGINT AS c_custkey, split,
       {", ".join(f"(c_mktsegment IS NOT DISTINCT FROM '{v}')::BIGINT AS c_mktsegment_{v}" for v in SEGMENTS_AT_SF001)}
FROM s""")
def one_hot(spark, d):
    cust = split_exact(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", 42, 0.3)
    cats = encode.one_hot_categories(cust.where(F.col("split") == "train"), "c_mktsegment")
    df = encode.one_hot(cust, "c_mktsegment", cats)
    return df.select(b("c_custkey"), "split", *[b(c) for c in df.columns if c.startswith("c_mktsegment_")])


@query("combine_encode", "F3", sql=f"""
WITH c AS (SELECT c_custkey, concat(coalesce(c_nationkey::VARCHAR, 'nan'), '_', coalesce(c_mktsegment, 'nan')) AS cb FROM customer)
SELECT c.c_custkey::BIGINT AS c_custkey, coalesce(k.code, -1)::BIGINT AS c_nationkey_c_mktsegment
FROM c LEFT JOIN {_sql_codes("c", "cb")} k ON c.cb = k.k""")
def combine_encode(spark, d):
    df = encode.combine_encode(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"),
                               "c_nationkey", "c_mktsegment")
    return df.select(b("c_custkey"), b("c_nationkey_c_mktsegment"))


@query("assemble_features", "E4", sql=f"""
WITH {OF}
SELECT o_orderkey::BIGINT AS o_orderkey, pos::BIGINT AS pos, {sr("value")} AS value FROM (
  SELECT o_orderkey, unnest([{", ".join(ds.FEATURE_SQL)}]) AS value, unnest(range(5)) AS pos FROM order_features)""")
def assemble_features(spark, d):
    return long_form(ds.order_vectors(spark, d), ["o_orderkey"], "features")


@query("freq_encode", "A2", sql=f"""
WITH {OF}, base AS (SELECT o_orderkey, n_lines, coalesce(n_returned, -1) AS n_returned_f FROM order_features),
f1 AS (SELECT n_lines AS k, count(*)::DOUBLE / sum(count(*)) OVER () AS f FROM base WHERE n_lines IS NOT NULL GROUP BY n_lines),
f2 AS (SELECT n_returned_f AS k, count(*)::DOUBLE / sum(count(*)) OVER () AS f FROM base WHERE n_returned_f IS NOT NULL GROUP BY n_returned_f)
SELECT base.o_orderkey::BIGINT AS o_orderkey,
       {sr("CASE WHEN base.n_lines = -1 THEN -1.0 ELSE f1.f END")} AS n_lines_FE,
       {sr("CASE WHEN base.n_returned_f = -1 THEN -1.0 ELSE f2.f END")} AS n_returned_f_FE
FROM base LEFT JOIN f1 ON base.n_lines = f1.k LEFT JOIN f2 ON base.n_returned_f = f2.k""")
def freq_encode(spark, d):
    df = ds.order_features(spark, d).select("o_orderkey", "n_lines",
                                            F.coalesce("n_returned", F.lit(-1)).alias("n_returned_f"))
    df = encode.freq_encode(df, ["n_lines", "n_returned_f"])
    return df.select(b("o_orderkey"), r("n_lines_FE"), r("n_returned_f_FE"))


EVENTS_SENT_SQL = """ev AS (SELECT event_id, user_id, event_type, value,
  CASE WHEN event_type = 'error' THEN -1.0::DOUBLE ELSE value END AS v_sent FROM events)"""


def _events_sent(spark, d):
    ev = table(spark, d, "events")
    return ev.select("event_id", "user_id", "event_type", "value",
                     F.when(F.col("event_type") == "error", F.lit(-1.0)).otherwise(F.col("value")).alias("v_sent"))


@query("group_stat_encode", "A3 N3 J2", sql=f"""
WITH {EVENTS_SENT_SQL},
st AS (SELECT user_id, avg(nullif(value, -1.0)) AS m1, stddev_samp(nullif(value, -1.0)) AS s1,
              avg(nullif(v_sent, -1.0)) AS m2, stddev_samp(nullif(v_sent, -1.0)) AS s2 FROM ev GROUP BY user_id)
SELECT ev.event_id::BIGINT AS event_id, ev.user_id::BIGINT AS user_id,
       {sr("coalesce(m1, -1.0)")} AS value_user_id_mean, {sr("coalesce(s1, -1.0)")} AS value_user_id_std,
       {sr("coalesce(m2, -1.0)")} AS v_sent_user_id_mean, {sr("coalesce(s2, -1.0)")} AS v_sent_user_id_std
FROM ev LEFT JOIN st ON ev.user_id = st.user_id""")
def group_stat_encode(spark, d):
    df = encode.group_stat_encode(_events_sent(spark, d), ["value", "v_sent"], ["user_id"], ["mean", "std"],
                                  usena=True, fillna=True)
    return df.select(b("event_id"), b("user_id"), r("value_user_id_mean"), r("value_user_id_std"),
                     r("v_sent_user_id_mean"), r("v_sent_user_id_std"))


@query("group_nunique_encode", "A4", sql="""
SELECT e.event_id::BIGINT AS event_id, e.user_id::BIGINT AS user_id, c.ct::BIGINT AS user_id_event_type_ct
FROM events e LEFT JOIN (SELECT user_id, count(DISTINCT event_type) AS ct FROM events GROUP BY user_id) c ON e.user_id = c.user_id""")
def group_nunique_encode(spark, d):
    df = encode.group_nunique_encode(table(spark, d, "events").select("event_id", "user_id", "event_type"),
                                     ["event_type"], ["user_id"])
    return df.select(b("event_id"), b("user_id"), b("user_id_event_type_ct"))


# ---------------------------------------------------------------- 2.5 scaling

SCALE_COLS = ["o_totalprice", "n_lines", "sum_qty", "avg_disc"]


@query("standardize_sample", "A5", sql=f"""
WITH {OF}
SELECT o_orderkey::BIGINT AS o_orderkey,
       {", ".join(sr(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()") + f" AS {c}" for c in SCALE_COLS)}
FROM order_features""")
def standardize_sample(spark, d):
    df = scale.standardize_sample(ds.order_features(spark, d).select("o_orderkey", *SCALE_COLS), SCALE_COLS)
    return df.select(b("o_orderkey"), *[r(c) for c in SCALE_COLS])


@query("standardize_population", "A6", sql=f"""
WITH {OF}
SELECT o_orderkey::BIGINT AS o_orderkey,
       {", ".join(sr(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()") + f" AS {c}" for c in SCALE_COLS)},
       0.0::DOUBLE AS one
FROM order_features""")
def standardize_population(spark, d):
    df = ds.order_features(spark, d).select("o_orderkey", *SCALE_COLS, F.lit(1.0).alias("one"))
    df = scale.standardize_population(df, SCALE_COLS + ["one"])
    return df.select(b("o_orderkey"), *[r(c) for c in SCALE_COLS], r("one"))


SHIFT_COLS = ["o_totalprice", "n_lines", "sum_qty", "avg_disc", "max_price"]


@query("min_shift", "A7", sql=f"""
WITH {OF}
SELECT o_orderkey::BIGINT AS o_orderkey, {sr("CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END")} AS o_totalprice,
       {", ".join(sr(f"coalesce({c} - min({c}) OVER (), -1.0)") + f" AS {c}" for c in SHIFT_COLS[1:])}
FROM order_features""")
def min_shift(spark, d):
    df = ds.order_features(spark, d).select("o_orderkey", *SHIFT_COLS)
    df = df.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")))   # null exempt amounts
    df = scale.min_shift(df, SHIFT_COLS, exempt=["o_totalprice"])
    return df.select(b("o_orderkey"), *[r(c) for c in SHIFT_COLS])


# ---------------------------------------------------------------- 2.4 joins, 2.8 union

@query("left_join_identity", "J1", sql="""
SELECT o.o_orderkey::BIGINT AS o_orderkey, o.o_custkey::BIGINT AS o_custkey, c.c_name, c.c_nationkey::BIGINT AS c_nationkey,
       floor(c.c_acctbal * 1e2 + 0.5) / 1e2 AS c_acctbal, c.c_mktsegment
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey""")
def left_join_identity(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    df = joins.left_join(o, c, "o_custkey", "c_custkey")
    return df.select(b("o_orderkey"), b("o_custkey"), "c_name", b("c_nationkey"), r("c_acctbal", places=2), "c_mktsegment")


# The replacement map of the part-type column.
TYPE_MAP = {"ECONOMY": "Eco", "PROMO": "Promo", "STANDARD": "Std"}


@query("replace_mapping", "J3", sql="""
SELECT p_partkey::BIGINT AS p_partkey,
       CASE p_type WHEN 'ECONOMY' THEN 'Eco' WHEN 'PROMO' THEN 'Promo' WHEN 'STANDARD' THEN 'Std' ELSE p_type END AS p_type
FROM part""")
def replace_mapping(spark, d):
    p = table(spark, d, "part")
    return p.select(b("p_partkey"), S.replace_mapping("p_type", TYPE_MAP).alias("p_type"))


@query("score_label_join", "J5 M3", sql=f"""
WITH {OF}
SELECT o_orderkey::BIGINT AS o_orderkey, {sr(ds.sql_sigmoid(ds.sql_logit()))} AS p, label::BIGINT AS label FROM order_features""")
def score_label_join(spark, d):
    from ..operators.linear import linear_score
    vec = ds.order_vectors(spark, d)
    scores = linear_score(vec.select("o_orderkey", "features"), "features", ds.LINEAR_WEIGHTS, ds.LINEAR_BIAS)
    labels = table(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderpriority").isin(*ds.POSITIVE_PRIORITIES).cast("int").alias("label"))
    df = joins.align_by_key(scores.select("o_orderkey", "p"), labels, "o_orderkey")
    return df.select(b("o_orderkey"), r("p"), b("label"))


@query("tagged_union", "U1", sql=f"""
WITH {OF}, s AS ({sql_split("order_features", "o_orderkey", 42, 0.3)})
SELECT o_orderkey::BIGINT AS o_orderkey, split, {sr("o_totalprice - min(o_totalprice) OVER ()", 2)} AS shifted_price FROM s""")
def tagged_union(spark, d):
    s = split_exact(ds.order_features(spark, d).select("o_orderkey", "o_totalprice"), "o_orderkey", 42, 0.3)
    parts = {name: joins.split_back(s, name) for name in ("train", "test")}
    u = joins.tagged_union(parts)
    shifted = scale.min_shift(u, ["o_totalprice"])
    return shifted.select(b("o_orderkey"), "split", r("shifted_price", F.col("o_totalprice"), places=2))


# ---------------------------------------------------------------- 2.9 scalar functions

@query("extract_letters", "F1", sql="""
SELECT p_partkey::BIGINT AS p_partkey, nullif(regexp_extract(p_brand, '([A-Za-z]+)', 1), '') AS brand_letters,
       nullif(regexp_extract(p_name, '([A-Za-z]+)', 1), '') AS name_letters FROM part""")
def extract_letters(spark, d):
    p = table(spark, d, "part")
    return p.select(b("p_partkey"), S.extract_first("p_brand", S.LETTER_RUN).alias("brand_letters"),
                    S.extract_first("p_name", S.LETTER_RUN).alias("name_letters"))


@query("extract_title", "F2", sql="""
SELECT doc_id::BIGINT AS doc_id, nullif(regexp_extract(text, ' ([A-Za-z]+)\\.', 1), '') AS title FROM documents""")
def extract_title(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(b("doc_id"), S.extract_first("text", S.TITLE_BEFORE_DOT).alias("title"))


@query("fractional_part", "F4", sql=f"""
SELECT o_orderkey::BIGINT AS o_orderkey, {sr("o_totalprice - floor(o_totalprice)")} AS cents FROM orders""")
def fractional_part(spark, d):
    o = table(spark, d, "orders")
    return o.select(b("o_orderkey"), r("cents", S.fractional_part("o_totalprice")))


@query("capped_sum", "F5", sql=f"""
WITH {OF}
SELECT o_orderkey::BIGINT AS o_orderkey,
       (CASE WHEN n_lines + n_returned > 6 THEN 6 ELSE n_lines + n_returned END)::DOUBLE AS family_size FROM order_features""")
def capped_sum(spark, d):
    # nullable count reported as DOUBLE on both sides (null is NaN in both engines' frames)
    df = ds.order_features(spark, d)
    return df.select(b("o_orderkey"), S.capped_sum("n_lines", "n_returned", 6).cast("double").alias("family_size"))


# Bin edges and labels of the two binning queries.
QTY_EDGES = [0, 50, 100, 150, 200, 400]
QTY_LABELS = ["q0", "q1", "q2", "q3", "q4"]
DISC_EDGES = [-math.inf, 0.02, 0.04, 0.06, 0.08, math.inf]
DISC_LABELS = ["d0", "d1", "d2", "d3", "d4"]


def _sql_bins_left(col, edges, labels):
    arms = " ".join(f"WHEN {col} >= {float(lo)!r}::DOUBLE AND {col} < {float(hi)!r}::DOUBLE THEN '{lab}'"
                    for lo, hi, lab in zip(edges[:-1], edges[1:], labels))
    return f"CASE {arms} ELSE 'Unknown' END"


def _sql_bins_right(col, edges, labels):
    arms = []
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = f"{col} > {float(lo)!r}::DOUBLE" if not math.isinf(lo) else f"{col} > '-inf'::DOUBLE"
        if not math.isinf(hi):
            cond += f" AND {col} <= {float(hi)!r}::DOUBLE"
        arms.append(f"WHEN {cond} THEN '{lab}'")
    return f"CASE {' '.join(arms)} ELSE 'Unknown' END"


@query("bin_left_closed", "F6", sql=f"""
WITH {OF}
SELECT o_orderkey::BIGINT AS o_orderkey, {_sql_bins_left("sum_qty", QTY_EDGES, QTY_LABELS)} AS qty_bin FROM order_features""")
def bin_left_closed(spark, d):
    df = ds.order_features(spark, d)
    return df.select(b("o_orderkey"), S.bin_left_closed("sum_qty", QTY_EDGES, QTY_LABELS).alias("qty_bin"))


@query("bin_right_closed", "F7", sql=f"""
WITH {OF}
SELECT o_orderkey::BIGINT AS o_orderkey, {_sql_bins_right("avg_disc", DISC_EDGES, DISC_LABELS)} AS disc_bin FROM order_features""")
def bin_right_closed(spark, d):
    df = ds.order_features(spark, d)
    return df.select(b("o_orderkey"), S.bin_right_closed("avg_disc", DISC_EDGES, DISC_LABELS).alias("disc_bin"))


@query("interaction_features", "F8", sql=f"""
WITH {OF}
SELECT o_orderkey::BIGINT AS o_orderkey, {sr("(o_orderstatus IS NOT DISTINCT FROM 'O')::INT::DOUBLE * o_totalprice", 2)} AS open_price,
       {sr("n_lines::DOUBLE * avg_disc")} AS lines_disc FROM order_features""")
def interaction_features(spark, d):
    df = ds.order_features(spark, d)
    return df.select(b("o_orderkey"), r("open_price", S.interaction(S.flag_equals("o_orderstatus", "O"), "o_totalprice"), 2),
                     r("lines_disc", S.interaction("n_lines", "avg_disc")))
