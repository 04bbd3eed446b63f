from collections import defaultdict

import numpy as np
import pytest

from keelson.llm import linededup
from tests.llm import brute


def by_definition(rows, min_chars=20, min_docs=3):
    """(n_lines, n_dropped, kept text) of each of (doc_id, text)."""
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(brute.LOWER)
    ident = lambda i: linededup.NO_ID if i is None else i
    owners = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                owners[key(line)].add(ident(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [s for s in lines if len(owners.get(key(s), ())) < min_docs or max(owners[key(s)]) == ident(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def rows_of(df):
    return [(r.id, r.n_lines, r.n_dropped, r.text) for r in df.collect()]


@pytest.mark.parametrize("name", ["small", "odd"])
def test_by_definition(request, name):
    docs = request.getfixturevalue(name)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(rows_of(linededup.dedup_lines(docs)), key=str) == sorted(by_definition(rows), key=str)


def test_lines(spark):
    common = "This line is in every document of all"
    rows = [(i, f"{common}\nown line number {i} of this one\n\t {common.upper()} \r") for i in range(40)]
    rows += [(40, "short line\n" * 3), (41, "short line\n\n"), (42, "short line"), (7, f"{common}\nsame id again"), (None, common), (None, "Ä" * 20), (50, "Ä" * 20), (51, "ä" * 20 + "\n" + "Ä" * 20 + "\r")]
    rows += [(100 + i, "\n".join(f"line {j} of the twenty that are shared" for j in range(20))) for i in range(5)] + [(60, ""), (61, "\n"), (62, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for keys in (linededup.SHARD_KEYS, 2):  # one shard, and many
        assert sorted(rows_of(linededup.dedup_lines(docs, shard_keys=keys)), key=str) == sorted(by_definition(rows), key=str)
    low = linededup.dedup_lines(docs, min_chars=3, min_docs=2)
    assert sorted(rows_of(low), key=str) == sorted(by_definition(rows, 3, 2), key=str)


def test_perfect_hash():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 63, 5000):
        h = rng.integers(0, 1 << 63, (n, 2)).astype(np.uint64)
        h[: n // 2, 0] = 7  # one half may be equal
        for most in (48, 2):  # with a listed rest
            index = linededup.PerfectHash.build(h, most=most) if n < 100 or most > 2 else linededup.PerfectHash.build(h)
            assert sorted(index.numbers(h).tolist()) == list(range(n))
        others = index.numbers(rng.integers(0, 1 << 63, (100, 2)).astype(np.uint64))
        assert ((others >= -1) & (others < max(1, n))).all()


def test_carried_columns_and_empty(odd, none):
    out = linededup.dedup_lines(odd, carry=odd.columns)
    assert out.columns == ["id", "text", "row", "n_lines", "n_dropped"] and out.select("row.*").columns == odd.columns
    assert sorted(map(str, out.select("row.*").collect())) == sorted(map(str, odd.collect()))
    assert linededup.dedup_lines(none).collect() == []
