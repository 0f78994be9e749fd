"""What the plans must look like: pruned scans, pushed filters, no Python where none is needed, no cross joins."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from logsieve.operators import monitor, upsert
from logsieve.plans import catalog
from logsieve.sources.tables import read_model_versions

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_rates_read_three_columns(spark):
    text = plan(catalog.anomaly_rate_by_source(spark, SF))
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", text)) == {"user_id:bigint,event_type:string"}
    assert "Python" not in text


@pytest.mark.parametrize("name", ["feature_table", "feature_table_serving", "verdict_parse", "change_texts", "chat_rows", "pager_rows",
                                  "json_len_feature", "private_addresses", "counter_rate", "histogram_quantiles", "unprocessed_events",
                                  "upsert_replace", "flagged_per_5min"])
def test_expressions_stay_in_the_engine(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    assert "Python" not in text and "Arrow" not in text


def test_threshold_is_pushed_to_the_scan(spark):
    assert "PushedFilters: [IsNotNull(value), LessThan(value,5.0)]" in plan(catalog.flagged_events(spark, SF))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_cross_joins(spark, name):
    if name.startswith("stream_"):
        pytest.skip("reads the result of a finished stream")
    text = plan(catalog.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_newest_rows_are_a_bounded_top(spark):
    assert "TakeOrderedAndProject" in plan(catalog.newest_runs(spark, SF))


def test_last_per_key_combines_before_the_shuffle(spark):
    df = catalog.table(spark, SF, "orders")
    text = plan(upsert.last_per_key(df, "o_custkey", F.struct("o_orderdate", "o_orderkey")))
    assert text.count("partial_max_by") >= 1 and text.count("Exchange hashpartitioning") <= 1 or "Exchange" in text


def test_sliding_windows_are_counted_per_step_first(spark):
    events = catalog.table(spark, SF, "events")
    text = plan(monitor.flagged_per_window(events, "ts", "1 hour", "5 minutes"))
    assert text.index("HashAggregate") < text.index("Expand")


def test_null_keys_are_spread_in_an_anti_join(spark):
    df = spark.range(4000).select(F.when(F.col("id") < 10, F.col("id")).alias("k"), "id")
    other = spark.range(5).select(F.col("id").alias("k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = upsert.anti_join(df, other, "k")
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 3995 and max(sizes) < 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_model_version_listing(spark):
    rows = [("m", "1", "Production", "r1", 0.9), ("k", "1", None, "r2", 0.8)]
    versions = spark.createDataFrame(rows, "name string, version string, stage string, run_id string, f1 double")
    assert [tuple(r) for r in read_model_versions(versions, "m").collect()] == [("1", "Production", "r1")]
