import random

import numpy as np
import pytest

from keelson.llm import toxicity as tox


def test_held_out_labels(spark):
    """Accuracy on labels that training never sees, at the bench scale."""
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in tox.op8_toxicity(spark, d).collect() if r.held_out and r.doc_id in labels]
    hit = sum(r.predicted and labels[r.doc_id] for r in rows)
    assert len(rows) > 500
    assert sum(r.predicted == labels[r.doc_id] for r in rows) / len(rows) > 0.96
    assert hit / sum(r.predicted for r in rows) > 0.9 and hit / sum(labels[r.doc_id] for r in rows) > 0.7


def test_planted_words_are_learned(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        words = [f"w{r.randrange(300)}" for _ in range(40)]
        bad = i % 6 == 0
        if bad:
            words[r.randrange(40)] = r.choice(["vile,", "NASTY***", "foul."])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad) if i < 600 else None))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = tox.fit_toxicity(docs, marks)
    assert len(model[1]) < 2000  # L1 leaves few weights
    out = {x.id: x.score for x in tox.score_toxicity(docs, model).collect()}
    assert all((out[i] >= 0.5) == (i % 6 == 0) for i in range(600, 900)) and all(0 <= s <= 1 for s in out.values())


def test_features():
    a, b = tox.occurrences("Alpha beta, gamma"), tox.occurrences("alpha BETA gamma!!")
    assert (a == b).all() and len(a) == 3 + 2 + 1 and a.max() < 1 << tox.BITS
    assert len(tox.occurrences("")) == 0 and len(tox.occurrences("*** ...")) == 0 and len(tox.occurrences("one")) == 1


def test_ftrl_by_the_formula():
    """The vectorised update against one coordinate at a time."""
    r = np.random.default_rng(0)
    rows = [(np.unique(r.integers(0, 40, 6)), int(r.random() < 0.4)) for _ in range(60)]
    bias, at, w = tox.train_ftrl(rows, epochs=2, alpha=0.5, beta=1.0, l1=0.3, l2=0.1)
    z, n, zb, nb = {}, {}, 0.0, 0.0
    weight = lambda i: 0.0 if abs(z.get(i, 0)) <= 0.3 else (np.sign(z[i]) * 0.3 - z[i]) / ((1 + np.sqrt(n[i])) / 0.5 + 0.1)
    for _ in range(2):
        for f, y in rows:
            b = -zb / ((1 + np.sqrt(nb)) / 0.5)
            ws = {i: weight(i) for i in f}
            g = 1 / (1 + np.exp(-(sum(ws.values()) + b))) - y
            for i in f:
                z[i] = z.get(i, 0) + g - (np.sqrt(n.get(i, 0) + g * g) - np.sqrt(n.get(i, 0))) / 0.5 * ws[i]
                n[i] = n.get(i, 0) + g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / 0.5 * b
            nb += g * g
    got = dict(zip(at.tolist(), w.tolist()))
    assert all(abs(got.get(i, 0.0) - weight(i)) < 1e-5 for i in range(40)) and abs(bias + zb / ((1 + np.sqrt(nb)) / 0.5)) < 1e-9


@pytest.mark.parametrize("marks", [[], [(6, None)], [(6, 1), (7, 1)], [(None, 1)]])
def test_odd_rows(spark, odd, none, marks):
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    model = tox.fit_toxicity(odd, labels)
    out = tox.score_toxicity(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    if not [1 for i, y in marks if i is not None and y is not None]:
        assert all(r.score < 1e-9 for r in out)
    assert tox.score_toxicity(none, model).collect() == []
