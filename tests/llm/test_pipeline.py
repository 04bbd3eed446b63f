import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from keelson.llm import bpe
from keelson.session import scratch_path
from tests.llm import brute

SF = "/root/testdata/sf0.01"


def kept_by_definition(spark, rows):
    """What quality rules, exact dedup and near-duplicates leave of (doc_id, text, source), in plain Python."""
    good = brute.kept(rows)
    left = [(i, t, s) for i, t, s in rows if i in good]
    last = {}
    for i, t, s in left:
        last[(t or "").translate(brute.LOWER)] = max(i, last.get((t or "").translate(brute.LOWER), -1))
    left = [(i, t, s) for i, t, s in left if last[(t or "").translate(brute.LOWER)] == i]
    parts = brute.components([(i, t) for i, t, _ in left])
    return [(i, t, s) for i, t, s in left if parts[i] == i]


def test_stages_and_result(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, frame, SF)
        assert out.columns == docs.columns
        path = scratch_path(spark, f"test-{name}")
        out.write.mode("overwrite").parquet(path)
        frame = spark.read.parquet(path)
    left = kept_by_definition(spark, rows)
    assert sorted((r.doc_id, r.text) for r in frame.collect()) == sorted((i, t) for i, t, _ in left)

    mixed = corpus_pipeline.STAGES[3][1](spark, frame, SF)
    assert mixed.columns == docs.columns
    copies = Counter(r.doc_id for r in mixed.collect())
    assert set(copies) <= {i for i, _, _ in left} and max(copies.values()) <= 3
    # each source's words come near its target: never above, and short of it by less than a document
    sizes, taken = Counter(), Counter()
    for i, t, s in left:
        sizes[s] += len(brute.words(t))
        taken[s] += len(brute.words(t)) * copies[i]
    from tests.llm.test_mixing import water_fill
    target = water_fill(dict(sizes))
    assert all(-1e-6 <= target[s] - taken[s] <= 0.02 * target[s] for s in sizes)

    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    library = Tokenizer.from_file(public_tokenizers.path(bpe.WORD_BPE))
    library.no_truncation()
    want = []
    for i, t, _ in left:
        ids = library.encode(t, add_special_tokens=False).ids
        row = (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        want += [row] * copies[i]
    assert got == sorted(want)


def test_odd_rows_run_through(spark, odd, none):
    for source in (odd, none):
        frame = source
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, frame, SF)
            path = scratch_path(spark, f"test-odd-{k}-{source is none}")
            out.write.mode("overwrite").parquet(path)
            frame = spark.read.parquet(path)
            assert k == 4 or frame.columns == source.columns
        assert frame.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
