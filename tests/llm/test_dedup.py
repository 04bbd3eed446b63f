import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from keelson.llm import dedup
from tests.llm.brute import LOWER


def check(rows, source):
    groups = defaultdict(list)
    for i, t in source:
        groups[(t or "").translate(LOWER)].append(i)
    digest = {hashlib.sha256(t.encode()).hexdigest(): (max((i for i in g if i is not None), default=None), len(g)) for t, g in groups.items()}
    assert len(rows) == len(source)
    assert sum(r.kept for r in rows) == len(groups)
    return digest


@pytest.mark.parametrize("name", ["small", "odd"])
def test_groups(request, name):
    docs = request.getfixturevalue(name)
    rows = dedup.exact_dedup(docs).collect()
    want = check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    for r in rows:
        assert (r.keep_id, r.group_size) == want[r.digest]
        assert not r.kept or r.id == r.keep_id


def test_colliding_digests_are_told_apart(small):
    """A digest of a few values: the full texts decide."""
    docs = small.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.lit("Same TEXT")).otherwise(F.col("text")))
    rows = dedup.exact_dedup(docs, digest=lambda t: F.pmod(F.xxhash64(t), F.lit(7)).cast("string")).collect()
    source = [(r.doc_id, r.text) for r in docs.collect()]
    check(rows, source)
    best = {}
    for i, t in source:
        best[(t or "").translate(LOWER)] = max(i, best.get((t or "").translate(LOWER), -1))
    text = dict(source)
    sizes = defaultdict(int)
    for i, t in source:
        sizes[(t or "").translate(LOWER)] += 1
    for r in rows:
        key = (text[r.id] or "").translate(LOWER)
        assert r.keep_id == best[key] and r.group_size == sizes[key]


def test_several_batches_share_the_state(spark, small):
    """A tiny batch limit: a micro-batch per file, the keyed state carries over."""
    docs = small.union(small).repartition(6)
    rows = dedup.exact_dedup(docs, batch_bytes=1).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])


def test_stage_keeps_columns(odd):
    out = dedup.stage_exact_dedup(None, odd, "")
    assert out.columns == odd.columns and out.count() == len({(r.text or "").translate(LOWER) for r in odd.collect()})


def test_empty(none):
    assert dedup.exact_dedup(none).collect() == []
