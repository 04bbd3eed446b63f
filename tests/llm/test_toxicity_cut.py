import numpy as np

from keelson.llm import toxicity as tox


def test_a_miss_weighs_as_much_as_a_false_alarm():
    """Three toxic texts for two clean ones lie between the cuts at 0.5 and 5.5: the lower one makes fewer errors."""
    margins = np.arange(9.0)
    labels = np.array([0, 1, 1, 0, 1, 0, 1, 1, 1])
    assert tox.best_cut(margins, labels) == 0.5


def test_fewest_errors_of_any_cut():
    r = np.random.default_rng(3)
    for _ in range(200):
        m, y = r.permutation(12).astype(float), np.append(r.integers(0, 2, 10), [0, 1])
        errors = lambda c: int(((m > c) != y).sum())
        assert errors(tox.best_cut(m, y)) == min(errors(c + 0.5) for c in range(11))
