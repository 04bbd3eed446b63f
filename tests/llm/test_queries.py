"""Registered queries against their DuckDB SQL, and their columns."""
import duckdb
import pytest

from keelson.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "op1": "doc_id size source_size target taken", "op2": "doc_id start n_tokens ids_crc32", "op3": "doc_id keep_id group_size kept text_sha256",
    "op4": "page_id text", "op5": "doc_id n_tokens ids_sha256 decoded_sha256", "op6": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op7": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op8": "doc_id held_out score predicted",
    "op9": "doc_id n_shingles component_id kept", "op10": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op11": "doc_id n_lines n_dropped kept_sha256", "op12": "vec_id component n deviation whitened explained identity_error",
    "op13": "lang rank phrase a l r n score",
}


def test_one_query_per_operator():
    assert sorted(q.split("_")[0] for q in QUERIES) == sorted(COLUMNS) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    table, per_row = {"op4": ("pages", 1), "op12": ("embeddings", 8), "op13": ("documents", None)}.get(name.split("_")[0], ("documents", 1))
    n = spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").count()
    assert df.columns[:len(COLUMNS[name.split('_')[0]].split())] == COLUMNS[name.split("_")[0]].split()
    assert df.count() == n * per_row if per_row else df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    got = QUERIES[name](spark, "/root/testdata/sf0.01").toPandas()
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.01/documents.parquet')")
    want = con.sql(ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(str, got[cols].values.tolist())) == sorted(map(str, want[cols].values.tolist()))
