"""Minibatch training in one barrier stage against a NumPy loop."""
import numpy as np
import pytest

from keelson.operators import net_training as T
from keelson.operators import nets as N
from keelson.operators.sample import minibatch_ids
from keelson.plans.q_models import net_weights
from keelson.session import scratch_path
from keelson.sources.weights import collect_layers

SQUARE = N.Net(1, 3, 4, (N.Dense("fc1", 6), N.Act("square"), N.Dense("fc2", 4)))
RELU = N.Net(1, 3, 4, (N.Dense("fc1", 8), N.Act("relu"), N.Dense("fc2", 5), N.Act("relu"), N.Dense("fc3", 4)))


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((210, 12)) * 0.4
    y = (x[:, :4] + 0.3 * x[:, 4:8]).argmax(axis=1)
    return spark.createDataFrame([(i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, y))], "image_id long, pixels array<double>, label int"), x, y


def loop(spark, df, x, y, net, epochs, batch, step):
    """One process, one row after the other batch; the order of the batches is that of minibatch_ids."""
    flat, losses = T.flatten_params(net, collect_layers(net_weights(spark, net), net.shapes())), []
    for e in range(epochs):
        at = {r.image_id: r.batch_id for r in minibatch_ids(df.select("image_id"), "image_id", batch, 5, epoch=e).collect()}
        ids = np.array([at[i] for i in range(len(x))])
        seen = []
        for b in range(ids.max() + 1):
            g, loss = N.gradient(net, T.unflatten_params(net, flat), x[ids == b], y[ids == b])
            seen.append(loss / (ids == b).sum())
            flat = step(flat, g / (ids == b).sum())
        losses.append(np.mean(seen))
    return flat, losses


def adam(lr, b1=0.9, b2=0.999, eps=1e-8):
    s = {"t": 0, "m": 0.0, "v": 0.0}

    def step(w, g):
        s["t"] += 1
        s["m"] = b1 * s["m"] + (1 - b1) * g
        s["v"] = b2 * s["v"] + (1 - b2) * g * g
        return w - lr * (s["m"] / (1 - b1 ** s["t"])) / (np.sqrt(s["v"] / (1 - b2 ** s["t"])) + eps)

    return step


def momentum(lr, mu):
    s = {"v": 0.0}

    def step(w, g):
        s["v"] = mu * s["v"] + g
        return w - lr * s["v"]

    return step


def flat_of(net, table):
    return T.flatten_params(net, collect_layers(table, net.shapes()))


@pytest.mark.parametrize("tasks", [1, 4, 7])
def test_adam_equals_the_loop(spark, data, tasks):
    df, x, y = data
    got, losses = T.train_net_minibatch(df, SQUARE, net_weights(spark, SQUARE), epochs=10, lr=0.01, seed=5, tasks=tasks)
    want, want_losses = loop(spark, df, x, y, SQUARE, 10, 64, adam(0.01))
    assert np.abs(flat_of(SQUARE, got) - want).max() < 1e-6 and np.allclose(losses, want_losses, atol=1e-6)
    assert losses[-1] < 0.9 * losses[0]


def test_momentum_and_resume(spark, data):
    df, x, y = data
    kind = dict(batch_size=32, optimizer="sgd", lr=0.05, momentum=0.5, seed=5, tasks=3)
    want, want_losses = loop(spark, df, x, y, RELU, 5, 32, momentum(0.05, 0.5))
    got, losses = T.train_net_minibatch(df, RELU, net_weights(spark, RELU), epochs=5, **kind)
    assert np.abs(flat_of(RELU, got) - want).max() < 1e-6 and np.allclose(losses, want_losses, atol=1e-6)
    # a training that stopped after two epochs goes on from its state; the given weights no longer matter
    folder = scratch_path(spark, "training/resume-test")
    T.train_net_minibatch(df, RELU, net_weights(spark, RELU), epochs=2, folder=folder, **kind)
    zeros = net_weights(spark, RELU).selectExpr("layer", "out_idx", "in_idx", "0D AS w")
    got, losses = T.train_net_minibatch(df, RELU, zeros, epochs=5, folder=folder, **kind)
    assert np.abs(flat_of(RELU, got) - want).max() < 1e-6 and np.allclose(losses, want_losses, atol=1e-6)


def test_a_lost_task_repeats_from_the_last_state(spark, data, tmp_path):
    """A task that dies once after the second epoch: Spark repeats the stage, which goes on from the state."""
    df, x, y = data
    mark = str(tmp_path / "died")
    real = T._save_state

    def dying(folder, epoch, **arrays):
        import os

        real(folder, epoch, **arrays)
        if epoch == 2 and not os.path.exists(mark):
            open(mark, "w").close()
            raise RuntimeError("lost")

    T._save_state = dying
    try:
        if spark.sparkContext.master.startswith("local") and "," not in spark.sparkContext.master:
            with pytest.raises(Exception, match="lost"):  # local mode gives a stage no second try
                T.train_net_minibatch(df, SQUARE, net_weights(spark, SQUARE), epochs=4, lr=0.01, seed=5, tasks=2, folder=str(tmp_path / "s"))
        got, _ = T.train_net_minibatch(df, SQUARE, net_weights(spark, SQUARE), epochs=4, lr=0.01, seed=5, tasks=2, folder=str(tmp_path / "s"))
    finally:
        T._save_state = real
    want, _ = loop(spark, df, x, y, SQUARE, 4, 64, adam(0.01))
    assert np.abs(flat_of(SQUARE, got) - want).max() < 1e-6


def test_odd_rows(spark, data):
    df, x, y = data
    odd = df.unionByName(spark.createDataFrame([(900, None, 1), (901, [0.0] * 12, None)], df.schema))
    got, _ = T.train_net_minibatch(odd, SQUARE, net_weights(spark, SQUARE), epochs=1, seed=5, tasks=2)
    want, _ = T.train_net_minibatch(df, SQUARE, net_weights(spark, SQUARE), epochs=1, seed=5, tasks=5)
    assert np.abs(flat_of(SQUARE, got) - flat_of(SQUARE, want)).max() < 1e-9
    same, none = T.train_net_minibatch(df.limit(0), SQUARE, net_weights(spark, SQUARE))
    assert none == [] and np.array_equal(flat_of(SQUARE, same), flat_of(SQUARE, net_weights(spark, SQUARE)))
    with pytest.raises(Exception, match="unique"):
        T.train_net_minibatch(df.unionByName(df), SQUARE, net_weights(spark, SQUARE), epochs=2)
