import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from keelson.llm import lm
from tests.llm import brute


def tokens(text):
    return [w.translate(brute.LOWER) for w in brute.words(text)]


def check(docs, rows, learn):
    p, begin, end, counts = brute.kneser_ney([tokens(t) for i, t in rows if learn(i)], lm.discounts)
    total, distinct = sum(counts.values()), len(counts)
    assert abs(sum(p("the", w) for w in counts) + p("the", object()) - 1) < 1e-9  # the seen words and one unseen
    model = lm.train_kneser_ney(docs.sparkSession.createDataFrame([(t or "",) for i, t in rows if learn(i)], "t string").repartition(3))
    assert (model["tokens"], model["words"]) == (total, distinct)
    want = {}
    for i, t in rows:
        s = [*tokens(t), end]
        want.setdefault(i, []).append((len(s), sum(counts[w] > 0 for w in s), sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in s),
                                       sum(math.log10(p(v, w)) for v, w in zip([begin, *s], s))))
    got = lm.score_texts(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        match = [x for x in want[r.id] if (r.n_tokens, r.n_known) == x[:2] and abs(r.base_score - x[2]) < 1e-6 * r.n_tokens and abs(r.score - x[3]) < 1e-6 * r.n_tokens]
        assert match, r


def test_scores(small, small_rows):
    check(small, [(i, t) for i, t, _ in small_rows], lambda i: zlib.crc32(str(i).encode()) % 7 != 2)


def test_scores_over_many_buckets(small, small_rows, monkeypatch):
    """Several shards, frequent contexts dealt by word, several combinations per task."""
    monkeypatch.setattr(lm, "BUCKET", 3000)
    monkeypatch.setattr(lm, "FLUSH", 5000)
    monkeypatch.setattr(lm, "SLICE", 20_000)
    check(small, [(i, t) for i, t, _ in small_rows], lambda i: i % 3 != 0)


def test_odd_rows(odd):
    check(odd, [(r.doc_id, r.text) for r in odd.collect()], lambda i: i != 13)


def test_model_beats_its_base_on_held_out_text(spark):
    rows = [r for r in lm.op6_language_model(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > 0.9 * sum(r.base_score for r in rows)


def test_empty(none, odd):
    empty = none.selectExpr("coalesce(text, '') AS t")
    model = lm.train_kneser_ney(empty)
    assert (model["tokens"], model["words"]) == (0, 0)
    assert lm.score_texts(none, model).collect() == []
    assert all(r.score == 0 and r.n_known == 0 for r in lm.score_texts(odd, model).collect())


@pytest.mark.parametrize("values", [[], [0], [5, 5, 7, 2 ** 40], list(range(1000))])
def test_packed_arrays(values):
    a = np.array(values, np.int64)
    assert (lm.unpack(lm.pack(a), np.int64) == a).all()


def test_token_hashes():
    h, at = lm.token_hashes(pa.array(["A b", "", " a\tB\n", "b"]))
    assert at.tolist() == [0, 3, 4, 7, 9] and h[0] == h[4] and h[1] == h[5] == h[7] and h[2] == h[3] == h[6] == h[8]
