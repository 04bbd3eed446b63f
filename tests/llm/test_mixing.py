from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from keelson.llm import mixing
from tests.llm import brute


def water_fill(sizes, weights=(5, 2, 1)):
    """Share by weight, cap at three times the size, reshare the excess until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3 * sizes[s]
            left -= 3 * sizes[s]
        free -= over
    return target


@pytest.mark.parametrize("name", ["small", "odd"])
def test_mix_meets_targets(request, name):
    docs = request.getfixturevalue(name)
    rows = mixing.mix_sources(docs, block_words=512, shard_blocks=4).collect()
    assert len(rows) == docs.count()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
    texts = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
    assert sorted(r["size"] for r in rows) == sorted(len(brute.words(r.text)) for r in docs.select("text").collect()) and texts
    want, taken = water_fill(sizes), defaultdict(int)
    for r in rows:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.copies <= 3 and len(r.placements) == r.copies
        taken[r.source] += r.size * r.copies
    assert all(-1e-6 <= want[s] - taken[s] <= max(r["size"] for r in rows if r.source == s) for s in sizes)
    again = mixing.mix_sources(docs, block_words=512, shard_blocks=4).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_production_blocks_come_near(spark):
    rows = mixing.mix_sources(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    target, taken = {r.source: r.target for r in rows}, defaultdict(int)
    for r in rows:
        taken[r.source] += r.size * r.copies
    assert all(0 <= target[s] - taken[s] <= 0.01 * target[s] for s in target)


def test_a_long_text_leaves_no_gap(spark):
    """Sources of texts of 100 words and one of 90,000, wherever its hash puts it: what fits is taken."""
    rows = [(1000 * k + i, "w " * 100, f"a{k:02d}") for k in range(10) for i in range(900)] + [(1000 * k + 950, "w " * 90_000, f"a{k:02d}") for k in range(10)]
    rows += [(50_000, "v " * 135_000, "b")]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2)).collect()
    for s in {r.source for r in out}:
        mine = [r for r in out if r.source == s]
        short = mine[0].target - sum(r["size"] * r.copies for r in mine)
        epochs = int(mine[0].target // mine[0].source_size)
        assert short > -1e-6 and all(r.copies == epochs + 1 for r in mine if r["size"] <= short), (s, short)
    assert sum(r.copies for r in out) > 900


def test_plan_size_does_not_depend_on_shards(spark):
    df = spark.createDataFrame([(f"s{i}", 3000 + i) for i in range(5)], "src string, draws long")
    sizes = {n: len(mixing.split_quotas(df, n, sum(3000 + i for i in range(5)))._jdf.queryExecution().analyzed().toString()) for n in (2, 64, 4096)}
    assert max(sizes.values()) - min(sizes.values()) < 200


def test_targets_by_iteration(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5, "d": 0, None: 70}, {"x": 1}, {"a": 0}, {f"s{i:02d}": i * i for i in range(40)}):
        df = spark.createDataFrame([("=" + s if s is not None else "", s, n) for s, n in sizes.items()], "src string, source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        want = water_fill(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in got)


def test_hypergeometric_law(spark):
    x = spark.range(6000).select(F.expr(mixing._hypergeometric("20L", "5L", "3L", mixing._uniform("7L", "id"))).alias("x"))
    got = {r.x: r["count"] / 6000 for r in x.groupBy("x").count().collect()}
    want = {0: 455 / 1140, 1: 525 / 1140, 2: 150 / 1140, 3: 10 / 1140}
    assert all(abs(got.get(k, 0) - p) < 0.02 for k, p in want.items()) and set(got) <= set(want)
    edge = spark.range(50).select(*[F.expr(mixing._hypergeometric(n, k, d, mixing._uniform("id"))).alias(a) for a, n, k, d in (
        ("none", "10L", "0L", "4L"), ("all", "10L", "10L", "4L"), ("zero", "0L", "0L", "0L"), ("whole", "9L", "4L", "9L"), ("big", "2000000000L", "1000000000L", "1000000L"))])
    for r in edge.collect():
        assert (r["none"], r["all"], r["zero"], r["whole"]) == (0, 4, 0, 4) and abs(r["big"] - 500_000) < 5000


def test_tree_keeps_quotas(spark):
    quotas = {"a": 1000, "b": 517, "c": 3, "d": 0}
    df = spark.createDataFrame(list(quotas.items()), "src string, draws long")
    rows = mixing.split_quotas(df, 13, 1520).collect()
    by_source, by_shard = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.quota >= 0
        by_source[r.src] += r.quota
        by_shard[r.shard] += r.quota
    assert dict(by_source) == quotas
    assert [by_shard[i] for i in range(13)] == [(i + 1) * 1520 // 13 - i * 1520 // 13 for i in range(13)]


def test_rows_of_the_mix(small):
    mix = mixing.mix_sources(small, block_words=512, shard_blocks=4, carry=small.columns)
    rows = mixing.mixed_rows(mix)
    assert rows.columns == ["shard", "epoch", "id", "row"]
    want = {r.id: r.copies for r in mix.collect() if r.copies}
    got = {r.id: r["count"] for r in rows.groupBy("id").count().collect()}
    assert got == want
    assert rows.groupBy("id", "epoch").count().filter("count > 1").isEmpty()


def test_empty(none):
    assert mixing.mix_sources(none).collect() == []
    assert mixing.mixed_rows(mixing.mix_sources(none, carry=none.columns)).select("row.*").columns == none.columns
