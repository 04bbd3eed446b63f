"""Plan shape checks: the scale properties verified with explain() stay true."""

import re

from pyspark.sql import functions as F

from keelson.operators import ranking
from keelson.plans.catalog import QUERIES
from tests.conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_needed_columns(spark):
    p = plan(QUERIES["flagship_order_metrics"](spark, SF_SMALL))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", p)
    assert schemas, p
    for s in schemas:
        assert "l_shipdate" not in s and "o_orderdate" not in s and "l_returnflag" not in s


def test_label_encode_streams_data_through_broadcast_lookups(spark):
    p = plan(QUERIES["label_encode"](spark, SF_SMALL))
    assert "SortMergeJoin" not in p
    assert p.count("BroadcastHashJoin") >= 3


def test_bucketed_rank_has_no_single_partition_window_over_rows(spark):
    df = spark.range(1000).withColumn("g", (F.col("id") % 2).cast("int"))
    p = plan(ranking.hash_rank(df, "id", 1, by=["g"]))
    rank_windows = [line for line in p.splitlines() if "Window [" in line and "row_number()" in line]
    assert rank_windows, p
    for line in rank_windows:                     # the row-level window is partitioned by bucket
        partition_spec = line.split("], [")[1]
        assert "_b#" in partition_spec and "g#" in partition_spec


def test_group_stats_join_materialised_table_by_broadcast(spark):
    p = plan(QUERIES["group_stat_encode"](spark, SF_SMALL))
    assert "SortMergeJoin" not in p
    assert "BroadcastHashJoin" in p and "Scan ExistingRDD" in p
