import numpy as np

from keelson.operators.nets import score_net
from keelson.plans import digits


def _naive_forward(x, p):
    """Loop implementation of the two-conv network (independent of nets.forward)."""
    def conv(t, w, b, k):
        c_out, c_in = w.shape[0], t.shape[0]
        h = t.shape[1] - k + 1
        out = np.zeros((c_out, h, h))
        for o in range(c_out):
            for i in range(h):
                for j in range(h):
                    out[o, i, j] = (t[:, i:i + k, j:j + k] * w[o].reshape(c_in, k, k)).sum() + b[o]
        return out

    def pool(t):
        c, h, _ = t.shape
        return t.reshape(c, h // 2, 2, h // 2, 2).max(axis=(2, 4))

    t = x.reshape(1, 28, 28)
    t = np.maximum(pool(conv(t, *p["conv1"], 5)), 0)
    t = np.maximum(pool(conv(t, *p["conv2"], 5)), 0)
    t = np.maximum(p["fc1"][0] @ t.ravel() + p["fc1"][1], 0)
    return p["fc2"][0] @ t + p["fc2"][1]


def test_conv_pool_net_matches_naive_loops(spark):
    rng = np.random.default_rng(0)
    shapes = {"conv1": (10, 1, 5, 5), "conv2": (20, 10, 5, 5), "fc1": (50, 320), "fc2": (10, 50)}
    p = {k: (rng.normal(0, 0.2, s), rng.normal(0, 0.1, s[0])) for k, s in shapes.items()}
    X = rng.random((3, 784))
    imgs = spark.createDataFrame([(i, [float(v) for v in x], i % 10) for i, x in enumerate(X)],
                                 "image_id long, pixels array<double>, label int")
    w = digits.weights_table(spark, p)
    got = {r["image_id"]: np.array(r["logits"]) for r in score_net(imgs, digits.CONV_POOL_NET, w).collect()}
    for i, x in enumerate(X):
        assert np.allclose(got[i], _naive_forward(x, p), atol=1e-9)
    ev = digits.evaluate_digits(imgs, digits.CONV_POOL_NET, w)
    assert ev["per_class_accuracy"].count() == 10 and ev["loss"].first()["n"] == 3


def test_architecture_shapes():
    assert digits.CONV_SQUARE_NET.shapes()["fc1"] == (1024, 256)
    assert digits.CONV_POOL_NET.shapes()["fc1"] == (50, 320)
    assert digits.DENSE_RELU_NET.shapes()["fc1"] == (128, 784)
