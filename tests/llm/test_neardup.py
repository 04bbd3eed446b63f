import random

import numpy as np
import pytest

from keelson.llm import neardup
from keelson.llm.components import components
from tests.llm import brute


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute.components(rows)
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    sizes = {i: len(brute.shingles(t)) for i, t in rows}
    for r in got:
        if r.id is None:
            assert r.component is None and r.kept
        else:
            assert (r.component, r.n_shingles, r.kept) == (want[r.id], sizes[r.id], r.id == want[r.id])


@pytest.mark.parametrize("name", ["small", "odd"])
def test_components(request, name):
    check(request.getfixturevalue(name))


def copies(groups=12, members=14, seed=4, length=120):
    """Groups of texts with words replaced at random, so similarities lie around the threshold."""
    r, rows = random.Random(seed), []
    common = [f"c{i}" for i in range(60)]  # a passage that all texts share
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(length)]
        for _ in range(members):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 4, 6, 9])):
                w[r.randrange(length)] = f"x{r.randrange(10 ** 6)}"
            rows.append(" ".join(w + (common if r.random() < 0.7 else [])))
    r.shuffle(rows)
    return list(enumerate(rows))


def test_links_around_the_threshold(spark):
    check(spark.createDataFrame(copies(), "doc_id long, text string").repartition(4))


def test_blocks_of_one_hot_group(spark, monkeypatch):
    """One group with several blocks of members and of queries."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "QUERY_BLOCK", 8)
    check(spark.createDataFrame(copies(groups=1, members=120, seed=9), "doc_id long, text string").repartition(4))


def test_sketch_keys_find_similar_sets():
    """Share of pairs at similarity 0.75 that share a table key: 1 - 1e-4 by the formula."""
    r = np.random.default_rng(2)
    import pyarrow as pa
    missed = 0
    for _ in range(150):
        words = [str(x) for x in r.integers(0, 10 ** 9, 160)]
        other = words[:]
        for k in range(4):  # 4 * 5 of 156 shingles change: 136 / 176 = 0.77
            other[20 + 35 * k] = "z" + str(r.integers(10 ** 9))
        s, at = neardup.shingles(pa.array([" ".join(words), " ".join(other)]))
        sig = np.stack([[(lambda h: (h ^ (h >> np.uint64(32))).min())(s[at[d]:at[d + 1]] * m) for m in neardup._MIN] for d in (0, 1)])
        same = (sig[0] == sig[1]).reshape(2, neardup.M, neardup.K).all(2)
        missed += not (same[0].any() and same[1].any())
    assert missed <= 1


def test_connected_components(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(100, 180)] + [(r.randrange(1000, 1400), r.randrange(1000, 1400)) for _ in range(220)] + [(5, 900), (900, 7), (3, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {x.id: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in got} and {x for x in parent if any(x in p and p[0] != p[1] for p in links)} == set(got)


def test_stage_keeps_columns(odd):
    out = neardup.stage_near_duplicates(None, odd, "")
    assert out.columns == odd.columns


def test_empty(none):
    assert neardup.near_duplicates(none).collect() == []
