"""Queries for kNN, oversampling, linear training and scoring, nets and the
relational convolution (SURVEY 2.4 J4, 2.7 L1 R4, 2.9 F9-F12 D1, 2.11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import array_sum, relu, square
from ..functions.hashing import sql_hash_uint32, sql_hash_uniform
from ..operators import knn as K
from ..operators import linear as L
from ..operators import nets as N
from ..operators.oversample import smote
from ..operators.sample import split_exact
from ..sources.images import to_rows
from ..sources.weights import formula_weights
from . import datasets as ds
from .q_tabular import sql_split
from .registry import b, long_form, query, r, sr

# ---------------------------------------------------------------- kNN

SPLIT_EMB_SQL = f"""s AS ({sql_split("embeddings", "vec_id", 42, 0.3)}),
pairs AS (SELECT q.vec_id AS qid, t.vec_id AS tid, t.label AS tl,
  list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(q.embedding, t.embedding),
      lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), lambda a, x: a + x) AS dist
  FROM s q JOIN s t ON q.split = 'test' AND t.split = 'train')"""


def _emb_split(spark, d):
    s = split_exact(ds.images(spark, d), "image_id", seed=42, test_ratio=0.3)
    return s.where(F.col("split") == "test"), s.where(F.col("split") == "train")


@query("knn_topk", "L1 D1", sql=f"""
WITH {SPLIT_EMB_SQL}, rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, tid) AS rank FROM pairs)
SELECT qid::BIGINT AS query_id, rank::BIGINT AS rank, tid::BIGINT AS neighbor_id, {sr("dist")} AS dist FROM rk WHERE rank <= 5""")
def q_knn_topk(spark, d):
    test, train = _emb_split(spark, d)
    nb = K.knn(test, train, 5, "image_id", "pixels", "image_id", "pixels", "label")
    return nb.select(b("query_id"), b("rank"), b("neighbor_id"), r("dist"))


@query("pairwise_distance", "J4 D1", sql=f"""
WITH {SPLIT_EMB_SQL}, rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, tid) AS rn FROM pairs)
SELECT qid::BIGINT AS query_id, max(CASE WHEN rn = 1 THEN tid END)::BIGINT AS nearest_id,
       {sr("max(CASE WHEN rn = 1 THEN dist END)")} AS min_dist, {sr("avg(dist)")} AS mean_dist, count(*)::BIGINT AS n_train
FROM rk GROUP BY qid""")
def q_pairwise(spark, d):
    test, train = _emb_split(spark, d)
    t = K.pairwise_summary(test, train, "image_id", "pixels", "image_id", "pixels")
    return t.select(b("query_id"), b("nearest_id"), r("min_dist"), r("mean_dist"), b("n_train"))


@query("knn_majority_vote", "M4", sql=f"""
WITH {SPLIT_EMB_SQL}, rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, tid) AS rank FROM pairs),
v AS (SELECT qid, tl, count(*) AS n FROM rk WHERE rank <= 5 GROUP BY qid, tl),
w AS (SELECT qid, tl, row_number() OVER (PARTITION BY qid ORDER BY n DESC, tl ASC) AS o FROM v)
SELECT qid::BIGINT AS query_id, tl::BIGINT AS pred FROM w WHERE o = 1""")
def q_knn_majority(spark, d):
    test, train = _emb_split(spark, d)
    t = K.knn_classify(test, train, 5, "image_id", "pixels", "image_id", "label", vote="majority")
    return t.select(b("query_id"), b("pred"))


@query("knn_mean_vote", "M5 F11", sql=f"""
WITH {SPLIT_EMB_SQL}, rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, tid) AS rank FROM pairs),
v AS (SELECT qid, avg(tl::DOUBLE) AS m FROM rk WHERE rank <= 3 GROUP BY qid)
SELECT qid::BIGINT AS query_id, {sr("m")} AS mean_label, round_even(m, 0)::BIGINT AS pred FROM v""")
def q_knn_mean(spark, d):
    test, train = _emb_split(spark, d)
    t = K.knn_classify(test, train, 3, "image_id", "pixels", "image_id", "label", vote="mean")
    return t.select(b("query_id"), r("mean_label"), b("pred"))


# ---------------------------------------------------------------- SMOTE

@query("smote_oversample", "R4", sql=f"""
WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS vec, (label = 0)::BIGINT AS y FROM embeddings),
m AS (SELECT id, vec, row_number() OVER (ORDER BY {sql_hash_uint32(42, "id")}, id) - 1 AS r FROM e WHERE y = 1),
d AS (SELECT a.id AS base_id, c.id AS neighbor_id,
        list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(a.vec, c.vec), lambda p: (p[1] - p[2]) * (p[1] - p[2]))),
                    lambda acc, x: acc + x) AS dist
      FROM m a JOIN m c ON a.id <> c.id),
nb AS (SELECT base_id, neighbor_id, row_number() OVER (PARTITION BY base_id ORDER BY dist, neighbor_id) AS nb_rank FROM d),
cnt AS (SELECT count(*) FILTER (WHERE y = 0) AS n_maj, count(*) FILTER (WHERE y = 1) AS n_min, max(id) AS mx FROM e),
s AS (SELECT range AS s FROM range((SELECT n_maj - n_min FROM cnt))),
syn AS (SELECT s.s, m.id AS base_id, m.vec AS base_vec, ({sql_hash_uint32(42, "'nb1'", "s.s")} % 5) + 1 AS nb_rank,
               {sql_hash_uniform(42, "'gap1'", "s.s")} AS gap
        FROM s JOIN m ON m.r = s.s % (SELECT n_min FROM cnt)),
syn2 AS (SELECT (SELECT mx FROM cnt) + 1 + syn.s AS id,
                list_transform(list_zip(syn.base_vec, n.vec), lambda p: p[1] + syn.gap * (p[2] - p[1])) AS vec, 1 AS y, 1 AS synthetic
         FROM syn JOIN nb ON nb.base_id = syn.base_id AND nb.nb_rank = syn.nb_rank JOIN m n ON n.id = nb.neighbor_id),
allr AS (SELECT id, vec, y, 0 AS synthetic FROM e UNION ALL SELECT id, vec, y, synthetic FROM syn2)
SELECT id::BIGINT AS id, y::BIGINT AS label, synthetic::BIGINT AS synthetic, (i - 1)::BIGINT AS pos, {sr("v")} AS value
FROM (SELECT id, y, synthetic, unnest(vec) AS v, generate_subscripts(vec, 1) AS i FROM allr)""")
def q_smote(spark, d):
    im = ds.images(spark, d).withColumn("y", (F.col("label") == 0).cast("int"))
    out = smote(im, "image_id", "pixels", "y", k=5, seed=42)
    return long_form(out, ["id", "label", "synthetic"], "vec")


# ---------------------------------------------------------------- linear models

OF = ds.ORDER_FEATURES_SQL


@query("linear_score", "M3 F9", sql=f"""
WITH {OF}
SELECT o_orderkey::BIGINT AS o_orderkey, {sr(ds.sql_logit())} AS logit, {sr(ds.sql_sigmoid(ds.sql_logit()))} AS p FROM order_features""")
def q_linear_score(spark, d):
    vec = ds.order_vectors(spark, d)
    t = L.linear_score(vec, "features", ds.LINEAR_WEIGHTS, ds.LINEAR_BIAS)
    return t.select(b("o_orderkey"), r("logit", L.linear_logit("features", ds.LINEAR_WEIGHTS, ds.LINEAR_BIAS)), r("p"))


GD_EPOCHS = 200
GD_LR = 0.1
ADAM_EPOCHS = 10
ADAM_LR = 0.01

_BCE = ("-(y * CASE WHEN p > 0 THEN greatest(ln(p), -100.0) ELSE -100.0 END"
        " + (1.0 - y) * CASE WHEN p < 1 THEN greatest(ln(1.0 - p), -100.0) ELSE -100.0 END)")


def _sql_rows() -> str:
    """CTE X of the training rows of the two training queries."""
    xs = ", ".join(f"{f} AS x{j}" for j, f in enumerate(ds.FEATURE_SQL))
    return f"{OF},\nX AS MATERIALIZED (SELECT {xs}, label::DOUBLE AS y FROM order_features)"


def _sql_epoch(nf: int) -> str:
    """The text of one epoch's gradients over the rows X and the recursive table W."""
    terms = " + ".join(f"x{j} * w{j}" for j in range(nf))
    p = f"(1.0::DOUBLE / (1.0::DOUBLE + exp(-((0.0::DOUBLE + {terms}) + b))))"
    kept = ", ".join(f"any_value({c}) AS {c}" for c in ["epoch", "b", *[f"w{j}" for j in range(nf)]])
    grads = ", ".join(f"sum((p - y) * x{j}) / count(*) AS g{j}" for j in range(nf))
    return (f"SELECT {kept}, {grads}, sum(p - y) / count(*) AS gb, sum({_BCE}) / count(*) AS loss{{extra}} "
             f"FROM (SELECT X.*, W.*, {p} AS p FROM X, W WHERE W.epoch < {{epochs}}) HAVING count(*) > 0")


def _sql_out(nf: int) -> str:
    outs = ", ".join(sr(f"w{j}") + f" AS w{j}" for j in range(nf))
    return f"SELECT epoch::BIGINT AS epoch, {sr('loss')} AS loss, {sr('b')} AS bias, {outs} FROM W WHERE epoch > 0"


def sql_gd_weights(nf: int, epochs: int, lr: float) -> str:
    """Recursive CTE W(epoch, loss, b, w0 ...): gradient descent from zero over the rows X(x0 ..., y)."""
    inner = _sql_epoch(nf)
    ws = [f"w{j}" for j in range(nf)]
    start = ", ".join(f"0.0::DOUBLE AS {w}" for w in ws)
    step = ", ".join(f"w{j} - {lr!r}::DOUBLE * g{j}" for j in range(nf))
    return (f"W(epoch, loss, b, {', '.join(ws)}) AS (SELECT 0, NULL::DOUBLE, 0.0::DOUBLE AS b, {start}\n"
            f"UNION ALL SELECT epoch + 1, loss, b - {lr!r}::DOUBLE * gb, {step} FROM ({inner.format(extra='', epochs=epochs)}))")


def _sql_gd(epochs: int, lr: float) -> str:
    nf = len(ds.FEATURE_SQL)
    return f"WITH RECURSIVE {_sql_rows()},\n{sql_gd_weights(nf, epochs, lr)}\n{_sql_out(nf)}"


def sql_adam_weights(nf: int, epochs: int, lr: float, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8) -> str:
    """Recursive CTE W(epoch, loss, b, w0 ..., moments): Adam from zero over the rows X(x0 ..., y)."""
    inner = _sql_epoch(nf)
    names = [*[f"w{j}" for j in range(nf)], "b"]
    grads = [*[f"g{j}" for j in range(nf)], "gb"]
    cols = ["epoch", "loss", "b", *names[:-1], *[f"m_{n}" for n in names], *[f"v_{n}" for n in names]]
    start = "SELECT 0, NULL::DOUBLE, " + ", ".join(["0.0::DOUBLE"] * (len(cols) - 2))
    extra = ", " + ", ".join(f"any_value({c}) AS {c}" for c in cols[3 + nf:])
    moments = ", ".join([f"{b1!r}::DOUBLE * m_{n} + {1 - b1!r}::DOUBLE * {g} AS m_{n}" for n, g in zip(names, grads)]
                        + [f"{b2!r}::DOUBLE * v_{n} + {1 - b2!r}::DOUBLE * {g} * {g} AS v_{n}" for n, g in zip(names, grads)])
    new = {n: f"{n} - {lr!r}::DOUBLE * (m_{n} / (1 - pow({b1!r}::DOUBLE, epoch))) / (sqrt(v_{n} / (1 - pow({b2!r}::DOUBLE, epoch))) + {eps!r}::DOUBLE)" for n in names}
    keep = ", ".join(["epoch", "loss", new["b"], *[new[n] for n in names[:-1]], *cols[3 + nf:]])
    return (f"W({', '.join(cols)}) AS ({start}\nUNION ALL SELECT {keep} FROM (SELECT epoch + 1 AS epoch, loss, "
            f"{', '.join(names)}, {moments} FROM ({inner.format(extra=extra, epochs=epochs)})))")


def _sql_adam(epochs: int, lr: float) -> str:
    nf = len(ds.FEATURE_SQL)
    return f"WITH RECURSIVE {_sql_rows()},\n{sql_adam_weights(nf, epochs, lr)}\n{_sql_out(nf)}"


def _history(spark, model):
    h = L.history_frame(spark, model)
    ws = [c for c in h.columns if c.startswith("w")]
    return h.select(b("epoch"), r("loss"), r("bias"), *[r(c) for c in ws])


@query("lr_train_gd", "M1", sql=_sql_gd(GD_EPOCHS, GD_LR))
def q_lr_gd(spark, d):
    model = L.train_gd(ds.order_vectors(spark, d), "features", "label", epochs=GD_EPOCHS, lr=GD_LR)
    return _history(spark, model)


@query("lr_train_adam", "M2", sql=_sql_adam(ADAM_EPOCHS, ADAM_LR))
def q_lr_adam(spark, d):
    model = L.train_adam(ds.order_vectors(spark, d), "features", "label", epochs=ADAM_EPOCHS, lr=ADAM_LR)
    return _history(spark, model)


# ---------------------------------------------------------------- nets

# Closed-formula weight parameters (a, b) per layer name.
LAYER_FORMULA = {"fc1": (7, 3), "fc2": (5, 2), "fc3": (3, 1), "conv1": (2, 5), "conv2": (3, 4)}

DENSE_SQUARE = N.Net(1, 8, 8, (N.Dense("fc1", 16), N.Act("square"), N.Dense("fc2", 8), N.Act("square"), N.Dense("fc3", 10)))
DENSE_RELU = N.Net(1, 8, 8, (N.Dense("fc1", 16), N.Act("relu"), N.Dense("fc2", 8), N.Act("relu"), N.Dense("fc3", 10)))
CONV_SQUARE = N.Net(1, 8, 8, (N.Conv("conv1", 4, 3, 2), N.Act("square"), N.Dense("fc1", 16), N.Act("square"),
                              N.Dense("fc2", 10)))
CONV_POOL = N.Net(1, 8, 8, (N.Conv("conv1", 2, 3, 1), N.Pool(2), N.Act("relu"), N.Conv("conv2", 4, 2, 1), N.Pool(2), N.Act("relu"),
                            N.Dense("fc1", 8), N.Act("relu"), N.Dense("fc2", 10)))


def net_weights(spark, net: N.Net):
    frames = [formula_weights(spark, name, o, i, *LAYER_FORMULA[name]) for name, (o, i) in net.shapes().items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _sql_w(name: str, n_out: int, n_in: int) -> str:
    a, bb = LAYER_FORMULA[name]
    return (f"W_{name} AS (SELECT o.range AS o, i.range AS j, ((({a} * o.range + {bb} * i.range) % 11) - 5)::DOUBLE / 16.0::DOUBLE AS w "
            f"FROM range({n_out}) o, range({n_in}) i),\n"
            f"B_{name} AS (SELECT o.range AS o, ((({a} * o.range + {bb} * {n_in}) % 11) - 5)::DOUBLE / 16.0::DOUBLE AS bias "
            f"FROM range({n_out}) o)")


def _sql_act(kind: str, z: str) -> str:
    return f"{z} * {z}" if kind == "square" else f"greatest({z}, 0.0::DOUBLE)"


def sql_net_ctes(net: N.Net) -> tuple[str, str]:
    """CTEs of the SQL forward pass (every layer is a join on the input index and a grouped sum), and the last one's name:
    logits as (id, j, v)."""
    shapes = net.shapes()
    ctes = ["x0 AS (SELECT vec_id AS id, (i - 1) AS j, v::DOUBLE AS v FROM "
            "(SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))"]
    cur = "x0"
    n = 0
    c, h, w = net.channels, net.height, net.width
    for layer in net.layers:
        n += 1
        t = f"t{n}"
        if isinstance(layer, N.Dense):
            o, i = shapes[layer.name]
            ctes.append(_sql_w(layer.name, o, i))
            ctes.append(f"{t} AS (SELECT x.id, W.o AS j, sum(x.v * W.w) + B.bias AS v FROM {cur} x "
                        f"JOIN W_{layer.name} W ON x.j = W.j JOIN B_{layer.name} B ON B.o = W.o GROUP BY x.id, W.o, B.bias)")
        elif isinstance(layer, N.Act):
            ctes.append(f"{t} AS (SELECT id, j, {_sql_act(layer.kind, 'v')} AS v FROM {cur})")
        elif isinstance(layer, N.Conv):
            o, i = shapes[layer.name]
            k, s = layer.kernel, layer.stride
            ho, wo = (h - k) // s + 1, (w - k) // s + 1
            ctes.append(_sql_w(layer.name, o, i))
            ctes.append(f"{t} AS (SELECT x.id, W.o * {ho * wo} + oh.range * {wo} + ow.range AS j, sum(x.v * W.w) + B.bias AS v "
                        f"FROM range({ho}) oh, range({wo}) ow, W_{layer.name} W JOIN B_{layer.name} B ON B.o = W.o, {cur} x "
                        f"WHERE x.j = (W.j // {k * k}) * {h * w} + (oh.range * {s} + (W.j % {k * k}) // {k}) * {w} "
                        f"+ ow.range * {s} + (W.j % {k}) GROUP BY x.id, W.o, oh.range, ow.range, B.bias)")
            c, h, w = o, ho, wo
        elif isinstance(layer, N.Pool):
            p = layer.size
            hp, wp = h // p, w // p
            ctes.append(f"{t} AS (SELECT id, (j // {h * w}) * {hp * wp} + ((j % {h * w}) // {w} // {p}) * {wp} "
                        f"+ ((j % {w}) // {p}) AS j, max(v) AS v FROM {cur} "
                        f"WHERE (j % {h * w}) // {w} < {hp * p} AND (j % {w}) < {wp * p} GROUP BY 1, 2)")
            h, w = hp, wp
        cur = t
    return ",\n".join(ctes), cur


def _sql_net(net: N.Net) -> str:
    held, cur = sql_net_ctes(net)
    ctes = [held]
    ctes.append(f"pr AS (SELECT id, j AS pred FROM (SELECT id, j, row_number() OVER (PARTITION BY id ORDER BY v DESC, j) AS o "
                f"FROM {cur}) WHERE o = 1)")
    return ("WITH " + ",\n".join(ctes) + f"\nSELECT z.id::BIGINT AS image_id, pr.pred::BIGINT AS pred, z.j::BIGINT AS pos, "
            f"{sr('z.v')} AS value FROM {cur} z JOIN pr ON z.id = pr.id")


def _score(spark, d, net):
    s = N.score_net(ds.images(spark, d), net, net_weights(spark, net))
    return long_form(s, ["image_id", "pred"], "logits")


@query("dense_square_score", "M6 F10", sql=_sql_net(DENSE_SQUARE))
def q_dense_square(spark, d):
    return _score(spark, d, DENSE_SQUARE)


@query("dense_relu_score", "M7 F10", sql=_sql_net(DENSE_RELU))
def q_dense_relu(spark, d):
    return _score(spark, d, DENSE_RELU)


@query("conv_square_score", "M8a", sql=_sql_net(CONV_SQUARE))
def q_conv_square(spark, d):
    return _score(spark, d, CONV_SQUARE)


@query("conv_pool_score", "M8b", sql=_sql_net(CONV_POOL))
def q_conv_pool(spark, d):
    return _score(spark, d, CONV_POOL)


PX_SQL = """px AS (SELECT vec_id AS id, (i - 1) AS p, v::DOUBLE AS v FROM
  (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))"""
WIN_SQL = f"""{PX_SQL},
win AS (SELECT px.id, oh.range AS oh, ow.range AS ow, q.range // 3 AS ki, q.range % 3 AS kj, px.v
        FROM range(6) oh, range(6) ow, range(9) q, px WHERE px.p = (oh.range + q.range // 3) * 8 + ow.range + q.range % 3)"""
CONV_REL_SQL = f"""{WIN_SQL}, {_sql_w("conv1", 2, 9)},
cv AS (SELECT win.id, W.o AS ch, win.oh, win.ow, sum(win.v * W.w) + B.bias AS z
       FROM win JOIN W_conv1 W ON W.j = win.ki * 3 + win.kj JOIN B_conv1 B ON B.o = W.o GROUP BY win.id, W.o, win.oh, win.ow, B.bias)"""


def _windows(spark, d):
    return N.im2col_windows(ds.images(spark, d), 8, 8, 3, 1)


def _conv_rel(spark, d):
    w = formula_weights(spark, "conv1", 2, 9, *LAYER_FORMULA["conv1"])
    return N.conv2d_relational(_windows(spark, d), w, "conv1", 3)


@query("im2col_windows", "M8c", sql=f"""
WITH {WIN_SQL}
SELECT id::BIGINT AS image_id, oh::BIGINT AS oh, ow::BIGINT AS ow, ki::BIGINT AS ki, kj::BIGINT AS kj, {sr("v")} AS v FROM win""")
def q_im2col(spark, d):
    w = _windows(spark, d)
    return w.select(b("image_id"), b("oh"), b("ow"), b("ki"), b("kj"), r("v"))


@query("conv2d_relational", "M8c", sql=f"""
WITH {CONV_REL_SQL}
SELECT id::BIGINT AS image_id, ch::BIGINT AS ch, oh::BIGINT AS oh, ow::BIGINT AS ow, {sr("z")} AS z FROM cv""")
def q_conv_rel(spark, d):
    z = _conv_rel(spark, d)
    return z.select(b("image_id"), b("ch"), b("oh"), b("ow"), r("z"))


@query("maxpool_relational", "M8c", sql=f"""
WITH {CONV_REL_SQL}
SELECT id::BIGINT AS image_id, ch::BIGINT AS ch, (oh // 2)::BIGINT AS ph, (ow // 2)::BIGINT AS pw, {sr("max(z)")} AS z
FROM cv GROUP BY id, ch, oh // 2, ow // 2""")
def q_maxpool_rel(spark, d):
    p = N.maxpool_relational(_conv_rel(spark, d), 2)
    return p.select(b("image_id"), b("ch"), b("ph"), b("pw"), r("z"))


@query("activation_compare", "F10", sql=f"""
SELECT vec_id::BIGINT AS image_id,
  {sr("list_reduce(list_prepend(0.0::DOUBLE, list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), lambda a, x: a + x)")} AS square_sum,
  {sr("list_reduce(list_prepend(0.0::DOUBLE, list_transform(embedding, lambda x: greatest(x::DOUBLE, 0.0::DOUBLE))), lambda a, x: a + x)")} AS relu_sum
FROM embeddings""")
def q_activation(spark, d):
    im = ds.images(spark, d).select("image_id", F.transform("pixels", lambda x: x.cast("double")).alias("x"))
    return im.select(b("image_id"), r("square_sum", array_sum(square("x"))), r("relu_sum", array_sum(relu("x"))))


@query("flatten_image", "F12", sql=f"""
SELECT vec_id::BIGINT AS image_id, (i - 1)::BIGINT AS pos, {sr("v::DOUBLE")} AS value
FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)""")
def q_flatten(spark, d):
    im = to_rows(ds.images(spark, d), "pixels", ds.IMAGE_W, out="rows2d")
    return long_form(im.select("image_id", F.flatten("rows2d").alias("flat")), ["image_id"], "flat")


TRAIN_NET = N.Net(1, 8, 8, (N.Dense("fc1", 16), N.Act("square"), N.Dense("fc2", 10)))
TRAIN_STEPS, TRAIN_LR = 3, 0.05


def _sql_train(steps: int, lr: float) -> str:
    """Gradient descent of TRAIN_NET in long form: forward, softmax, backward, update, ``steps`` times."""
    first = [_sql_w("fc1", 16, 64), _sql_w("fc2", 10, 16)]
    ctes = [PX_SQL, "lb AS (SELECT vec_id AS id, label AS y, (SELECT count(*) FROM embeddings) AS n FROM embeddings)", *first]
    w1, b1, w2, b2 = "W_fc1", "B_fc1", "W_fc2", "B_fc2"
    for t in range(1, steps + 1):
        ctes += [
            f"z1_{t} AS MATERIALIZED (SELECT px.id, W.o AS j, sum(px.v * W.w) + B.bias AS z FROM px JOIN {w1} W ON px.p = W.j JOIN {b1} B ON B.o = W.o GROUP BY px.id, W.o, B.bias)",
            f"z2_{t} AS MATERIALIZED (SELECT a.id, W.o AS j, sum(a.z * a.z * W.w) + B.bias AS z FROM z1_{t} a JOIN {w2} W ON a.j = W.j JOIN {b2} B ON B.o = W.o GROUP BY a.id, W.o, B.bias)",
            f"mx_{t} AS (SELECT id, max(z) AS m FROM z2_{t} GROUP BY id)",
            f"se_{t} AS (SELECT z.id, m, sum(exp(z.z - m)) AS s FROM z2_{t} z JOIN mx_{t} USING (id) GROUP BY z.id, m)",
            f"d2_{t} AS MATERIALIZED (SELECT z.id, z.j, lb.n, exp(z.z - m) / s - CASE WHEN lb.y = z.j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS d FROM z2_{t} z JOIN se_{t} USING (id) JOIN lb USING (id))",
            f"d1_{t} AS MATERIALIZED (SELECT a.id, a.j, any_value(d.n) AS n, sum(d.d * W.w) * 2.0 * a.z AS d FROM d2_{t} d JOIN {w2} W ON W.o = d.j JOIN z1_{t} a ON a.id = d.id AND a.j = W.j GROUP BY a.id, a.j, a.z)",
            f"W1_{t} AS MATERIALIZED (SELECT W.o, W.j, W.w - {lr!r}::DOUBLE * (sum(d.d * px.v) / any_value(d.n)) AS w FROM {w1} W JOIN d1_{t} d ON d.j = W.o JOIN px ON px.id = d.id AND px.p = W.j GROUP BY W.o, W.j, W.w)",
            f"B1_{t} AS MATERIALIZED (SELECT B.o, B.bias - {lr!r}::DOUBLE * (sum(d.d) / any_value(d.n)) AS bias FROM {b1} B JOIN d1_{t} d ON d.j = B.o GROUP BY B.o, B.bias)",
            f"W2_{t} AS MATERIALIZED (SELECT W.o, W.j, W.w - {lr!r}::DOUBLE * (sum(d.d * a.z * a.z) / any_value(d.n)) AS w FROM {w2} W JOIN d2_{t} d ON d.j = W.o JOIN z1_{t} a ON a.id = d.id AND a.j = W.j GROUP BY W.o, W.j, W.w)",
            f"B2_{t} AS MATERIALIZED (SELECT B.o, B.bias - {lr!r}::DOUBLE * (sum(d.d) / any_value(d.n)) AS bias FROM {b2} B JOIN d2_{t} d ON d.j = B.o GROUP BY B.o, B.bias)",
        ]
        w1, b1, w2, b2 = f"W1_{t}", f"B1_{t}", f"W2_{t}", f"B2_{t}"
    arms = [f"SELECT '{name}' AS layer, o, j AS i, w FROM {w} UNION ALL SELECT '{name}', o, -1, bias FROM {bb}" for name, w, bb in (("fc1", w1, b1), ("fc2", w2, b2))]
    return "WITH " + ",\n".join(ctes) + f"\nSELECT layer, o::BIGINT AS out_idx, i::BIGINT AS in_idx, {sr('w')} AS w FROM ({' UNION ALL '.join(arms)})"


@query("dense_train_steps", "M10", sql=_sql_train(TRAIN_STEPS, TRAIN_LR))
def q_train_steps(spark, d):
    trained, _ = N.train_net(ds.images(spark, d), TRAIN_NET, net_weights(spark, TRAIN_NET), steps=TRAIN_STEPS, lr=TRAIN_LR)
    return trained.select("layer", b("out_idx"), b("in_idx"), r("w"))


@query("dense_train_mlp", "M10")
def q_mlp(spark, d):
    # the stored labels carry no signal: the label is derived from the whole vector, the largest of the sums
    # of every third pixel
    im = ds.images(spark, d)
    thirds = F.array(*[F.expr(f"aggregate(filter(pixels, (x, i) -> i % 3 = {k}), 0D, (s, x) -> s + x)") for k in range(3)])
    im = im.withColumn("y", (F.array_position(thirds, F.array_max(thirds)) - 1).cast("int"))
    im = split_exact(im, "image_id", seed=42, test_ratio=0.3)
    model = N.train_mlp(im.where(F.col("split") == "train"), "pixels", "y", [64, 16, 3], max_iter=200, seed=7)
    out = N.mlp_predict(model, im, "pixels", ["image_id", "split", "y"])
    return out.select(b("image_id"), "split", b("y"), b("pred"))
