"""The verdict by all rules and the hosts' shrunk rates."""
from keelson.llm import quality
from tests.llm import brute

CLEAN = " ".join(f"w{i}" for i in range(30))
NOISY = " ".join(f"the&&& to%%% {i}" for i in range(30))
LINES = "\n".join([f"line {i} of the text" for i in range(4)] + ["the same line once more"] * 4)


def verdicts(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality.stage_quality(None, docs, "").collect()}
    return {r.id: r for r in quality.apply_quality(docs).collect()}, kept


def test_bad_documents_of_a_mixed_host_go_and_clean_ones_stay(spark):
    rows = [(i, CLEAN, f"h{i % 5}") for i in range(100)] + [(100 + i, NOISY, f"h{i % 5}") for i in range(10)] + [(200 + i, LINES, "h0") for i in range(3)]
    out, kept = verdicts(spark, rows)
    assert out[100].symbolic and out[200].duplicated and not out[0].symbolic and not out[0].duplicated
    assert kept == set(range(100))


def test_a_host_that_fails_often_is_held_to_less(spark):
    """The same 8% of symbols pass on a clean host and not where most documents have too many; clean ones pass on both."""
    some = " ".join([f"abcdefgh{i}&" for i in range(10)] + [f"w{i}" for i in range(15)])
    rows = [(i, CLEAN, "clean") for i in range(300)] + [(1000 + i, NOISY if i % 10 < 6 else CLEAN, "noisy") for i in range(300)]
    out, kept = verdicts(spark, [*rows, (2000, some, "clean"), (2001, some, "noisy")])
    share = out[2000].n_symbols / out[2000].word_chars
    assert 0.05 < share < 0.1 and out[2001].symbolic_rate > 0.5
    assert 2000 in kept and 2001 not in kept and 1009 in kept


def test_a_host_is_rejected_for_symbols_alone(spark):
    rows = [(i, NOISY, "bad") for i in range(300)] + [(300, CLEAN, "bad")] + [(1000 + i, CLEAN, f"ok{i % 20}") for i in range(600)]
    _, kept = verdicts(spark, rows)
    assert kept == set(range(1000, 1600))


def test_errors_against_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = quality.apply_quality(docs).withColumnRenamed("id", "doc_id")
    assert {r.doc_id for r in out.filter("kept").collect()} == brute.kept([(r.doc_id, r.text, r.source) for r in docs.collect()])
    assert out.filter("kept = base_failed").count() > 0
    rows = out.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("quality IS NOT NULL").selectExpr(
        "quality", "kept", "NOT base_failed AS passed").collect()
    wrong = lambda q, c: sum(r[c] != bool(q) for r in rows if r.quality == q) / sum(r.quality == q for r in rows)
    assert wrong(0, "kept") < 0.75 * wrong(0, "passed") and wrong(1, "kept") <= wrong(1, "passed") + 0.01
