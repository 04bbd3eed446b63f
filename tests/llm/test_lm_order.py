"""The language model of any order against a plain version."""
import math
import zlib
from collections import Counter, defaultdict

import pytest

from keelson.llm import lm
from tests.llm import brute

BEGIN, END = object(), object()


def kneser_ney(seqs, order):
    """p(context, w): interpolated over all orders; n-grams of up to ``order`` words with at most one begin."""
    grams = {k: Counter() for k in range(1, order + 1)}
    for s in seqs:
        t = [BEGIN, *s, END]
        for k in grams:
            grams[k].update(tuple(t[i - k + 1:i + 1]) for i in range(max(1, k - 1), len(t)))
    counts = {order: grams[order]}
    for k in range(1, order):
        left = Counter(g[1:] for g in grams[k + 1])
        counts[k] = Counter({g: c if g[0] is BEGIN else left[g] for g, c in grams[k].items()})
    d = {k: [0, *lm.discounts(*[sum(x == n for x in c.values()) for n in (1, 2, 3, 4)])] for k, c in counts.items()}
    totals, spare = defaultdict(int), defaultdict(float)
    for k, c in counts.items():
        for g, x in c.items():
            totals[g[:-1]] += x
            spare[g[:-1]] += d[k][min(x, 3)]

    def p(context, w):
        k, g = len(context) + 1, (*context, w)
        low = p(context[1:], w) if context else 1 / (len(counts[1]) + 1)
        if not totals[context]:
            return low
        c = counts[k].get(g, 0)
        return max(c - d[k][min(c, 3)], 0) / totals[context] + spare[context] / totals[context] * low

    return p


def tokens(text):
    return [w.translate(brute.LOWER) for w in brute.words(text)]


def check(docs, rows, order):
    learn = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    p = kneser_ney([tokens(t) for i, t in rows if learn(i)], order)
    model = lm.train_kneser_ney(docs.sparkSession.createDataFrame([(t or "",) for i, t in rows if learn(i)], "t string").repartition(3), order)
    want = defaultdict(list)
    for i, t in rows:
        s = [BEGIN, *tokens(t), END]
        want[i].append((len(s) - 1, sum(math.log10(p(tuple(s[max(0, j - order + 1):j]), s[j])) for j in range(1, len(s)))))
    for r in (got := lm.score_texts(docs, model).collect()):
        assert any(r.n_tokens == n and abs(r.score - x) < 1e-6 * n for n, x in want[r.id]), (r, want[r.id])
    assert len(got) == len(rows)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores(small, small_rows, order):
    check(small, [(i, t) for i, t, _ in small_rows], order)


@pytest.mark.parametrize("order", [3, 4])
def test_scores_over_many_buckets(small, small_rows, order, monkeypatch):
    monkeypatch.setattr(lm, "BUCKET", 3000)
    monkeypatch.setattr(lm, "FLUSH", 5000)
    monkeypatch.setattr(lm, "SLICE", 20_000)
    check(small, [(i, t) for i, t, _ in small_rows], order)


def test_counts_over_a_byte(spark):
    rows = [(i, "a b c d") for i in range(700)] + [(1000 + i, f"x{i} b c e") for i in range(300)] + [(2000, "")]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, 3)


def test_the_query_uses_more_than_one_word_of_context(spark, monkeypatch):
    of = {}
    for order in (2, lm.ORDER):
        monkeypatch.setattr(lm, "ORDER", order)
        of[order] = sum(r.score for r in lm.op6_language_model(spark, "/root/testdata/sf0.01").collect() if r.held_out)
    assert len(of) == 2 and of[lm.ORDER] > of[2]


def test_totals_above_32_bits():
    import numpy as np

    from keelson.llm import lm

    keys, total = np.array([3, 5, 8, 9], np.uint64), np.array([2, 2 ** 33 + 5, 1, 2 ** 32 - 1], np.int64)
    held = lm.context_arrays(keys, [total, np.array([1, 2, 1, 3]), np.array([0, 1, 0, 4]), np.array([0, 7, 0, 2 ** 31])])
    assert held[0].tolist() == [3, 5, 9]
    got = lm.context_statistics(held, np.array([2, 0, 1, 1]))
    assert [a.tolist() for a in got] == [[2 ** 32 - 1, 2, 2 ** 33 + 5, 2 ** 33 + 5], [3, 1, 2, 2], [4, 0, 1, 1], [2 ** 31, 0, 7, 7]]
