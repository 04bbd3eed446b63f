import numpy as np
from pyspark.sql import functions as F

from keelson.operators import linear as L
from keelson.operators import nets as N
from keelson.plans import q_models
from keelson.sources.weights import collect_layers, formula_matrix, formula_weights


def _images(spark, n=20, seed=0):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, 64))
    df = spark.createDataFrame([(i, [float(v) for v in x], int(i % 10)) for i, x in enumerate(X)],
                               "image_id long, pixels array<double>, label int")
    return X, df


def test_formula_weights_match_numpy(spark):
    w = collect_layers(formula_weights(spark, "fc", 4, 3, 7, 3), {"fc": (4, 3)})["fc"]
    W, b = formula_matrix(4, 3, 7, 3)
    assert np.array_equal(w[0], W) and np.array_equal(w[1], b)


def test_relational_conv_and_pool_equal_numpy(spark):
    X, df = _images(spark)
    w = formula_weights(spark, "conv1", 2, 9, 2, 5)
    z = N.conv2d_relational(N.im2col_windows(df, 8, 8, 3, 1), w, "conv1", 3)
    params = collect_layers(w, {"conv1": (2, 9)})
    net = N.Net(1, 8, 8, (N.Conv("conv1", 2, 3, 1),))
    ref = N.forward(net, params, X).reshape(len(X), 2, 6, 6)
    for r in z.collect():
        assert abs(r["z"] - ref[r["image_id"], r["ch"], r["oh"], r["ow"]]) < 1e-12
    pooled = N.maxpool_relational(z, 2)
    ref_p = ref.reshape(len(X), 2, 3, 2, 3, 2).max(axis=(3, 5))
    got = pooled.collect()
    assert len(got) == len(X) * 18
    for r in got:
        assert abs(r["z"] - ref_p[r["image_id"], r["ch"], r["ph"], r["pw"]]) < 1e-12


def test_score_net_matches_manual_dense(spark):
    X, df = _images(spark)
    net = q_models.DENSE_RELU
    weights = q_models.net_weights(spark, net)
    got = {r["image_id"]: (r["logits"], r["pred"]) for r in N.score_net(df, net, weights).collect()}
    h = X
    for name, act in (("fc1", True), ("fc2", True), ("fc3", False)):
        a, b = q_models.LAYER_FORMULA[name]
        o, i = net.shapes()[name]
        W, bias = formula_matrix(o, i, a, b)
        h = h @ W.T + bias
        if act:
            h = np.maximum(h, 0)
    for k in range(len(X)):
        assert np.allclose(got[k][0], h[k], atol=1e-10)
        assert got[k][1] == int(np.argmax(h[k]))


def _numpy_gd(X, y, epochs, lr):
    w, b = np.zeros(X.shape[1]), 0.0
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-(X @ w + b)))
        w, b = w - lr * ((p - y) @ X) / len(y), b - lr * (p - y).mean()
    return w, b


def _numpy_adam(X, y, epochs, lr, b1=0.9, b2=0.999, eps=1e-8):
    th = np.zeros(X.shape[1] + 1)
    m = np.zeros_like(th)
    v = np.zeros_like(th)
    for t in range(1, epochs + 1):
        p = 1 / (1 + np.exp(-(X @ th[:-1] + th[-1])))
        g = np.append(((p - y) @ X) / len(y), (p - y).mean())
        m = b1 * m + (1 - b1) * g
        v = b2 * v + (1 - b2) * g * g
        th = th - lr * (m / (1 - b1 ** t)) / (np.sqrt(v / (1 - b2 ** t)) + eps)
    return th[:-1], th[-1]


def _lr_data(spark):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(300, 3))
    y = (X @ np.array([1.0, -2.0, 0.5]) + 0.3 > 0).astype(float)
    df = spark.createDataFrame([([float(v) for v in x], int(t)) for x, t in zip(X, y)], "f array<double>, y int")
    return X, y, df


def test_train_gd_matches_numpy(spark):
    X, y, df = _lr_data(spark)
    m = L.train_gd(df, "f", "y", epochs=15, lr=0.5)
    w, b = _numpy_gd(X, y, 15, 0.5)
    assert np.allclose(m.weights, w, atol=1e-10) and abs(m.bias - b) < 1e-10
    assert len(m.history) == 15 and m.history[0]["loss"] > m.history[-1]["loss"]


def test_train_adam_matches_numpy(spark):
    X, y, df = _lr_data(spark)
    m = L.train_adam(df, "f", "y", epochs=12, lr=0.05)
    w, b = _numpy_adam(X, y, 12, 0.05)
    assert np.allclose(m.weights, w, atol=1e-10) and abs(m.bias - b) < 1e-10


def test_mlp_beats_majority_on_separable_label(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(400, 8))
    y = (X[:, 0] + X[:, 1] > 0).astype(int)
    df = spark.createDataFrame([(i, [float(v) for v in x], int(t)) for i, (x, t) in enumerate(zip(X, y))],
                               "id long, f array<double>, y int")
    model = N.train_mlp(df, "f", "y", [8, 6, 2], max_iter=200, seed=1)
    pred = N.mlp_predict(model, df, "f", ["id", "y"])
    acc = pred.select(F.avg((F.col("y") == F.col("pred")).cast("double"))).first()[0]
    assert acc > max(y.mean(), 1 - y.mean()) + 0.1


def test_wide_input(spark):
    """400 features take the same path as few."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(120, 400))
    y = (x[:, 0] > 0).astype(int)
    df = spark.createDataFrame([([float(v) for v in r], int(c)) for r, c in zip(x, y)], "f array<double>, y int")
    model = L.train_gd(df, "f", "y", epochs=3, lr=0.5)
    w, b = np.zeros(400), 0.0
    for _ in range(3):
        e = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w - 0.5 * (e @ x) / 120, b - 0.5 * e.mean()
    assert np.allclose(model.weights, w, atol=1e-12) and abs(model.bias - b) < 1e-12


def test_validation_accuracy_per_epoch(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 3))
    y = (x @ [1.0, -2.0, 0.5] + 0.3 * rng.normal(size=300) > 0).astype(int)
    df = spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))], "id int, f array<double>, y int")
    fit, val = df.where("id < 200"), df.where("id >= 200")
    model = L.train_gd(fit, "f", "y", epochs=6, lr=0.5, validation=val)
    alone = L.train_gd(fit, "f", "y", epochs=6, lr=0.5)
    assert np.allclose(model.weights, alone.weights, atol=1e-12) and alone.history[-1]["val_accuracy"] is None
    for h in model.history:
        p = 1 / (1 + np.exp(-(x[200:] @ h["weights"] + h["bias"])))
        assert abs(h["val_accuracy"] - ((p > 0.5) == (y[200:] == 1)).mean()) < 1e-12


def test_net_training_learns(spark):
    """ReLU and square nets by minibatches with momentum: gradients by finite differences, and the loss falls."""
    rng = np.random.default_rng(13)
    x = rng.normal(size=(200, 16))
    y = (x[:, :8].sum(1) > 0).astype(int)
    df = spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))], "image_id long, pixels array<double>, label int")
    for kind in ("relu", "square"):
        net = N.Net(1, 4, 4, (N.Dense("fc1", 6), N.Act(kind), N.Dense("fc2", 2)))
        params = {n: (rng.normal(size=s) / 4, rng.normal(size=s[0]) / 4) for n, s in net.shapes().items()}
        g, loss = N.gradient(net, params, x[:9], y[:9])
        for at, (name, part, place) in ((0, ("fc1", 0, (0, 0))), (96, ("fc1", 1, 0)), (102, ("fc2", 0, (0, 0))), (114, ("fc2", 1, 0))):
            moved = {n: [p.copy() for p in ps] for n, ps in params.items()}
            moved[name][part][place] += 1e-6
            assert abs((N.gradient(net, moved, x[:9], y[:9])[1] - loss) / 1e-6 - g[at]) < 1e-3
        rows = [(n, o, i, float(v)) for n, (w, b) in params.items() for o, line in enumerate(np.column_stack([b, w])) for i, v in enumerate(line, -1)]
        table = spark.createDataFrame(rows, "layer string, out_idx int, in_idx int, w double")
        trained, losses = N.train_net(df, net, table, steps=16, lr=0.05, momentum=0.9, batch_size=50)
        assert len(losses) == 16 and np.mean(losses[-4:]) < 0.8 * np.mean(losses[:4])
        assert collect_layers(trained, net.shapes())["fc1"][0].shape == (6, 16)


def test_incomplete_weights_are_refused(spark):
    import pytest
    w = formula_weights(spark, "fc1", 3, 4)
    assert collect_layers(w, {"fc1": (3, 4)})["fc1"][0].shape == (3, 4)
    for bad in (w.where("NOT (out_idx = 1 AND in_idx = 2)"), w.union(w.limit(1)), w.where("in_idx >= 0"), w.where("layer = 'fc9'")):
        with pytest.raises(ValueError):
            collect_layers(bad, {"fc1": (3, 4)})
