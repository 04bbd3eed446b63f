import pytest

from keelson.llm import quality
from tests.llm import brute


@pytest.mark.parametrize("name", ["small", "odd"])
def test_counts(request, name):
    docs = request.getfixturevalue(name)
    got = sorted((str(r.id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.apply_quality(docs).collect())
    assert got == sorted((str(r.doc_id), *brute.quality(r.text)) for r in docs.collect())


def test_repeats(spark):
    texts = ["a b c d e f g h " * 3 + "x", "\n".join(["one line of words here now"] * 4), "p q " * 30, "x " * 9, " ".join(map(str, range(40))) + " " + " ".join(map(str, range(8)))]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.id: (r.n_words, r.n_dup_lines, r.n_repeat_words) for r in quality.apply_quality(docs).collect()}
    assert got == {i: (q[0], q[3], q[4]) for i, q in ((i, brute.quality(t)) for i, t in enumerate(texts))}


def test_host_verdict_shrinks(spark):
    """A host that fails nearly always is rejected, also its passing page; a small host is shrunk to the corpus rate."""
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, "short", "bad") for i in range(300)] + [(300, good, "bad")] + [(1000 + i, good, f"ok{i % 20}") for i in range(600)] + [(5000, "short", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.id: r for r in quality.apply_quality(docs).collect()}
    assert not out[300].kept and not out[300].base_failed and out[300].host_rejected
    assert not out[5000].host_rejected and all(out[1000 + i].kept for i in range(600))


def test_stage_keeps_columns(odd):
    out = quality.stage_quality(None, odd, "")
    assert out.columns == odd.columns
    assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in odd.collect() if not brute.quality(r.text)[-1]}


def test_empty(none):
    assert quality.apply_quality(none).collect() == []
