"""Corpus pipeline: documents -> quality rules -> exact dedup -> near-duplicates -> source mixing -> BPE.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the next
stage's ``docs``; all but the last return the columns of documents. The intermediate tables of a stage live in the
shared scratch folder and are deleted when the next stage begins, when its result has been written.

Defined results, by stage (columns other than doc_id, text and source are carried, whatever their names):

* quality_rules: documents that fail a rule, or whose host does, go; a null or empty text has no words and fails, a null
  source is a host of its own, repeated rows are judged and kept each, a very long text is counted whole;
* exact_dedup: of equal texts (A-Z lower-cased) the row with the largest doc_id stays; a null text equals an empty one, of
  rows equal in text and id one stays, a null id is below all others;
* near_duplicates: of each linked group the least doc_id stays; texts without words and rows without id link with nothing
  and stay, repeated ids are one document, links are confirmed on whole texts;
* source_mixing: each row as often as the mix takes it (0 to 3 times); texts without words are not taken, a null source is
  a source of its own, ties go by hash, a text that does not fit the room left is passed over;
* bpe_round_trip: a row per row; a null text is empty and has no tokens.

An empty table gives an empty table in every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from keelson.llm.bpe import stage_bpe
from keelson.llm.common import delete_paths, recorded
from keelson.llm.dedup import stage_exact_dedup
from keelson.llm.mixing import stage_mixing
from keelson.llm.neardup import stage_near_duplicates
from keelson.llm.quality import stage_quality
from keelson.session import scratch_path


#: Intermediate tables of the stage that ran last; its result is written before the next stage begins.
_HELD: list[str] = []


def _staged(operator):
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        done = list(_HELD)
        _HELD.clear()
        delete_paths(spark, done)
        with recorded(_HELD):
            return operator(spark, docs, sf_dir)

    return stage


STAGES = [
    ("quality_rules", _staged(stage_quality)),
    ("exact_dedup", _staged(stage_exact_dedup)),
    ("near_duplicates", _staged(stage_near_duplicates)),
    ("source_mixing", _staged(stage_mixing)),
    ("bpe_round_trip", _staged(stage_bpe)),
]

#: Mixing draws and near-duplicate search are not expressed in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; one row per row of the mix: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        result = stage(spark, docs, sf_dir)
        path = scratch_path(spark, f"pipeline/{name}-{uuid.uuid4().hex[:12]}")
        result.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
