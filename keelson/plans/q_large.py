"""Queries of the forms that take over where columns have very many values, keys are hot, fits are merged, and training
sides or nets are large: each gives the rows of the plain form (SURVEY 2.1-2.6, 2.9, 2.10)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import distinct, fitted, joins, sparse
from ..operators import nets as N
from ..operators.knn import _plain_sides
from ..operators.knn_pruned import knn_pruned
from ..operators.net_training import train_net_minibatch
from ..operators.sample import split_exact
from ..session import scratch_path
from ..sources.idx import read_idx, write_idx
from ..tables import table
from . import datasets as ds
from .q_models import CONV_POOL, CONV_SQUARE, TRAIN_NET, _emb_split, net_weights, sql_net_ctes
from .q_tabular import EVENTS_SENT_SQL, SCALE_COLS, _events_sent, sql_split
from .registry import ORACLES, b, long_form, query, r, sr

OF = ds.ORDER_FEATURES_SQL


# ---------------------------------------------------------------- image files

@query("scan_idx", "S4", sql=f"""
WITH n AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS image_id, label, embedding FROM embeddings)
SELECT image_id::BIGINT AS image_id, label::BIGINT AS label, (i - 1)::BIGINT AS pos, {sr("v::DOUBLE")} AS value
FROM (SELECT image_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM n)""")
def q_scan_idx(spark, d):
    path = scratch_path(spark, f"images-idx-{uuid.uuid4().hex}")
    im = ds.images(spark, d).repartitionByRange(4, "image_id").sortWithinPartitions("image_id")
    write_idx(im, path, ds.IMAGE_H, ds.IMAGE_W, kind="float")
    return long_form(read_idx(spark, path, range_rows=256), ["image_id", "label"], "pixels")


# ---------------------------------------------------------------- sparse features

SPARSE_COLS = ["c_name", "c_mktsegment"]
SPARSE_SQL = f"""s AS ({sql_split("customer", "c_custkey", 42, 0.3)}),
k1 AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS idx FROM (SELECT DISTINCT c_name AS v FROM s WHERE split = 'train' AND c_name IS NOT NULL)),
k2 AS (SELECT v, (SELECT count(*) FROM k1) + row_number() OVER (ORDER BY v) - 1 AS idx
       FROM (SELECT DISTINCT c_mktsegment AS v FROM s WHERE split = 'train' AND c_mktsegment IS NOT NULL)),
e AS (SELECT s.c_custkey, k1.idx FROM s JOIN k1 ON s.c_name = k1.v UNION ALL SELECT s.c_custkey, k2.idx FROM s JOIN k2 ON s.c_mktsegment = k2.v),
w AS (SELECT idx, ((7 * idx + 3) % 11 - 5)::DOUBLE / 16.0::DOUBLE AS w FROM (SELECT idx FROM k1 UNION ALL SELECT idx FROM k2)),
z AS (SELECT s.c_custkey, s.c_acctbal, coalesce(sum(w.w), 0.0::DOUBLE) + 0.125::DOUBLE AS z
      FROM s LEFT JOIN e ON e.c_custkey = s.c_custkey LEFT JOIN w ON w.idx = e.idx GROUP BY s.c_custkey, s.c_acctbal),
p AS (SELECT c_custkey, 1.0::DOUBLE / (1.0::DOUBLE + exp(-z)) AS p, CASE WHEN c_acctbal > 4500 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM z)"""


def _sparse_customers(spark, d):
    cust = split_exact(table(spark, d, "customer").select("c_custkey", "c_acctbal", *SPARSE_COLS), "c_custkey", 42, 0.3)
    layout = sparse.fit_one_hot_sparse(cust.where(F.col("split") == "train"), SPARSE_COLS)
    weights = spark.range(layout.size).select(F.col("id").alias("idx"), (((F.col("id") * 7 + 3) % 11 - 5).cast("double") / F.lit(16.0)).alias("w"))
    y = (F.col("c_acctbal") > F.lit(4500)).cast("int")
    return sparse.one_hot_sparse(cust, SPARSE_COLS, layout).withColumn("y", y), weights


@query("one_hot_sparse", "E3 E4", sql=f"""
WITH {SPARSE_SQL}
SELECT c_custkey::BIGINT AS c_custkey, (SELECT count(*) FROM w)::BIGINT AS size, idx::BIGINT AS idx, 1.0::DOUBLE AS value FROM e""")
def q_one_hot_sparse(spark, d):
    df, _ = _sparse_customers(spark, d)
    x = df.select("c_custkey", "vec.size", F.explode(F.arrays_zip(F.col("vec.indices").alias("i"), F.col("vec.values").alias("v"))).alias("e"))
    return x.select(b("c_custkey"), b("size"), b("idx", F.col("e.i")), F.col("e.v").alias("value"))


@query("sparse_linear_score", "M3 E3", sql=f"""
WITH {SPARSE_SQL}
SELECT c_custkey::BIGINT AS c_custkey, {sr("p")} AS p FROM p""")
def q_sparse_score(spark, d):
    df, weights = _sparse_customers(spark, d)
    return sparse.sparse_score(df, "vec", weights, 0.125, ["c_custkey"]).select(b("c_custkey"), r("p"))


@query("sparse_gradient", "M1 E3", sql=f"""
WITH {SPARSE_SQL}, n AS (SELECT count(*)::DOUBLE AS n FROM p)
SELECT e.idx::BIGINT AS idx, {sr("sum(p.p - p.y) / any_value(n.n)", 9)} AS g FROM e JOIN p USING (c_custkey), n GROUP BY e.idx
UNION ALL SELECT -1::BIGINT, {sr("sum(p.p - p.y) / any_value(n.n)", 9)} FROM p, n""")
def q_sparse_gradient(spark, d):
    df, weights = _sparse_customers(spark, d)
    return sparse.sparse_gradient(df, "vec", "y", weights, 0.125, "c_custkey").select(b("idx"), r("g", places=9))


# ---------------------------------------------------------------- bitmaps, hot keys

@query("group_nunique_bitmap", "A4", sql="""
SELECT e.event_id::BIGINT AS event_id, e.user_id::BIGINT AS user_id, c.t::BIGINT AS user_id_event_type_ct, c.d::BIGINT AS user_id_day_ct
FROM events e LEFT JOIN (SELECT user_id, count(DISTINCT event_type) AS t, count(DISTINCT ts::DATE) AS d FROM events GROUP BY user_id) c
ON e.user_id = c.user_id""")
def q_nunique_bitmap(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    parts = [ev.where(F.col("event_id") % 2 == k) for k in (0, 1)]  # states of two frames, merged
    out = distinct.group_nunique_bitmap(ev, ["event_type", "day"], ["user_id"], fit_on=parts)
    return out.select(b("event_id"), b("user_id"), b("user_id_event_type_ct"), b("user_id_day_ct"))


@query("hot_key_join", "J1 J2", sql="""
WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 20 < 9 THEN 1 ELSE l_partkey END AS k FROM lineitem)
SELECT l_orderkey::BIGINT AS l_orderkey, l_linenumber::BIGINT AS l_linenumber, k::BIGINT AS k, p.p_name, p.p_brand
FROM l LEFT JOIN part p ON l.k = p.p_partkey""")
def q_hot_key_join(spark, d):
    """45 % of the left rows have the key 1."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 20 < 9, F.lit(1)).otherwise(F.col("l_partkey")).cast("bigint").alias("k"))
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    out = joins.hot_key_join(li, part, "k", "p_partkey")
    return out.select(b("l_orderkey"), b("l_linenumber"), b("k"), "p_name", "p_brand")


# ---------------------------------------------------------------- merged fits

def _thirds(df, key):
    return [df.where(F.col(key) % 3 == k) for k in range(3)]


@query("scale_merged", "A5 A6 A7", sql=f"""
WITH {OF}
SELECT o_orderkey::BIGINT AS o_orderkey,
       {", ".join(sr(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()") + f" AS {c}_s" for c in SCALE_COLS)},
       {", ".join(sr(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()") + f" AS {c}_p" for c in SCALE_COLS)},
       {", ".join(sr(f"coalesce({c} - min({c}) OVER (), -1.0)") + f" AS {c}_m" for c in SCALE_COLS)}
FROM order_features""")
def q_scale_merged(spark, d):
    df = ds.order_features(spark, d).select("o_orderkey", *SCALE_COLS)
    state = None
    for part in _thirds(df, "o_orderkey"):
        fit = fitted.fit_moments_state(part, SCALE_COLS)
        state = fit if state is None else fitted.merge_moments(state, fit)
    state = state.persist()
    out = df
    for suffix, apply in (("s", lambda x, c: fitted.standardize_from(x, state, c)), ("p", lambda x, c: fitted.standardize_from(x, state, c, population=True)),
                          ("m", lambda x, c: fitted.min_shift_from(x, state, c))):
        done = apply(out.select("*", *[F.col(c).alias(f"_{c}") for c in SCALE_COLS]), SCALE_COLS)
        out = done.select(*[F.col(f"_{c}").alias(c) if c in SCALE_COLS else c for c in out.columns], *[F.col(c).alias(f"{c}_{suffix}") for c in SCALE_COLS])
    return out.select(b("o_orderkey"), *[r(f"{c}_{s}") for s in "spm" for c in SCALE_COLS])


@query("freq_encode_merged", "A2", sql=f"""
WITH {OF},
f1 AS (SELECT n_lines AS k, count(*)::DOUBLE / sum(count(*)) OVER () AS f FROM order_features WHERE n_lines IS NOT NULL GROUP BY n_lines),
f2 AS (SELECT o_orderstatus AS k, count(*)::DOUBLE / sum(count(*)) OVER () AS f FROM order_features WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus)
SELECT o_orderkey::BIGINT AS o_orderkey, {sr("f1.f")} AS n_lines_FE, {sr("f2.f")} AS o_orderstatus_FE
FROM order_features o LEFT JOIN f1 ON o.n_lines = f1.k LEFT JOIN f2 ON o.o_orderstatus = f2.k""")
def q_freq_merged(spark, d):
    cols = ["n_lines", "o_orderstatus"]
    df = ds.order_features(spark, d).select("o_orderkey", *cols)
    state = fitted.merge_counts(*[fitted.fit_counts_state(part, cols) for part in _thirds(df, "o_orderkey")])
    return fitted.freq_from(df, state, cols).select(b("o_orderkey"), r("n_lines_FE"), r("o_orderstatus_FE"))


@query("group_stat_merged", "A3 N3", sql=f"""
WITH {EVENTS_SENT_SQL},
st AS (SELECT user_id, avg(nullif(value, -1.0)) AS m1, stddev_samp(nullif(value, -1.0)) AS s1,
              avg(nullif(v_sent, -1.0)) AS m2, stddev_samp(nullif(v_sent, -1.0)) AS s2 FROM ev GROUP BY user_id)
SELECT ev.event_id::BIGINT AS event_id, ev.user_id::BIGINT AS user_id,
       {sr("coalesce(m1, -1.0)")} AS value_user_id_mean, {sr("coalesce(s1, -1.0)")} AS value_user_id_std,
       {sr("coalesce(m2, -1.0)")} AS v_sent_user_id_mean, {sr("coalesce(s2, -1.0)")} AS v_sent_user_id_std
FROM ev LEFT JOIN st ON ev.user_id = st.user_id""")
def q_group_stat_merged(spark, d):
    ev, mains = _events_sent(spark, d), ["value", "v_sent"]
    a, c = [fitted.fit_group_state(ev.where(F.col("event_id") % 2 == k), mains, "user_id", sentinel=-1) for k in (0, 1)]
    out = fitted.group_stats_from(ev, fitted.merge_moments(a, c, ["uid", "feature"]), mains, "user_id", ["mean", "std"])
    return out.select(b("event_id"), b("user_id"), *[r(f"{m}_user_id_{s}") for m in mains for s in ("mean", "std")])


# ---------------------------------------------------------------- nets as relations, pruned kNN, full training

def _sql_values(net: N.Net) -> str:
    ctes, cur = sql_net_ctes(net)
    return f"WITH {ctes}\nSELECT id::BIGINT AS image_id, j::BIGINT AS pos, {sr('v')} AS value FROM {cur}"


@query("conv_net_relational", "M8c M8b", sql=_sql_values(CONV_POOL))
def q_conv_net(spark, d):
    return N.relational_net(ds.images(spark, d), CONV_POOL, net_weights(spark, CONV_POOL)).select(b("image_id"), b("pos"), r("value"))


@query("conv_stride_relational", "M8c M8a", sql=_sql_values(CONV_SQUARE))
def q_conv_stride(spark, d):
    return N.relational_net(ds.images(spark, d), CONV_SQUARE, net_weights(spark, CONV_SQUARE)).select(b("image_id"), b("pos"), r("value"))


@query("knn_topk_pruned", "L1 D1", sql=ORACLES["knn_topk"])
def q_knn_pruned(spark, d):
    test, train = _emb_split(spark, d)
    q, t = _plain_sides(test, train, "image_id", "pixels", "image_id", "pixels", "label", None)
    nb, _ = knn_pruned(q, t, 5, block_rows=64, pivots=16)
    return nb.select(b("query_id"), b("rank"), b("neighbor_id"), r("dist"))


@query("dense_train_adam", "M10")
def q_train_adam(spark, d):
    """Ten epochs of batches of 64; compared with a NumPy loop in the tests (unrolled SQL is too slow)."""
    trained, _ = train_net_minibatch(ds.images(spark, d), TRAIN_NET, net_weights(spark, TRAIN_NET), epochs=10, batch_size=64, lr=0.001, seed=73)
    return trained.select("layer", b("out_idx"), b("in_idx"), r("w"))


RELU_NET = N.Net(1, 8, 8, (N.Dense("fc1", 16), N.Act("relu"), N.Dense("fc2", 8), N.Act("relu"), N.Dense("fc3", 10)))


@query("dense_train_momentum", "M10")
def q_train_momentum(spark, d):
    """Five epochs of batches of 64, gradient descent with momentum 0.5; compared with a NumPy loop in the tests."""
    trained, _ = train_net_minibatch(ds.images(spark, d), RELU_NET, net_weights(spark, RELU_NET), epochs=5, batch_size=64, optimizer="sgd",
                                     lr=0.01, momentum=0.5, seed=73)
    return trained.select("layer", b("out_idx"), b("in_idx"), r("w"))
