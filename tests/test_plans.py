"""What the plans must look like for the operators to hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

from logfathom.catalog import QUERIES
from logfathom.operators import select as sel
from logfathom.operators import series as ser
from logfathom.operators.labels import label_distribution
from logfathom.operators.patterns import top_patterns
from logfathom.operators.ranking import rank_series
from logfathom.operators.trend import trend_summary
from logfathom.sources.logs import events_logs

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def conf(spark):
    """Set run-time settings for one test."""
    before = {}

    def put(key, value):
        before.setdefault(key, spark.conf.get(key))
        spark.conf.set(key, value)

    yield put
    for key, value in before.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"streaming_counts"}))
def test_no_pairing_of_everything_with_everything(spark, conf, name):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    text = plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BroadcastHashJoin" not in text  # nothing is broadcast by hint, only by a checked size
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_label_and_time_filters_reach_the_scan(spark, conf):
    conf("spark.sql.maxMetadataStringLength", "1000")
    found = sel.select_logs(events_logs(spark, SMALL), [("event_type", "=", "error")], start="2024-01-05", end="2024-01-06")
    text = plan(found.select("id"))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema: (\S+)", text)
    assert "EqualTo(event_type,error)" in pushed[1] and "GreaterThanOrEqual(ts,2024-01-05T00:00)" in pushed[1]
    assert "value" not in pushed[2] and "props" not in pushed[2]


def final_plan(df):
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


def test_label_work_does_not_read_lines(spark):
    text = final_plan(label_distribution(events_logs(spark, SMALL)))
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in text and text.count("Scan parquet") == 1


@pytest.mark.parametrize("name", ["top_patterns_by_scope", "label_distribution_by_scope", "label_values", "top_error_patterns"])
def test_items_are_counted_once_and_limited_before_the_shuffle(spark, name):
    text = final_plan(QUERIES[name](spark, SMALL))
    assert text.count("Scan parquet") == 1 and "ReusedExchange" in text
    assert text.count("WindowGroupLimit") == 2 or "TakeOrderedAndProject" in text


def test_first_rows_per_scope_are_limited_before_the_shuffle(spark):
    text = plan(QUERIES["take_oldest_by_scope"](spark, SMALL))
    assert text.count("WindowGroupLimit") == 2
    assert text.rindex("WindowGroupLimit") > text.index("Exchange")
    assert "TakeOrderedAndProject" in plan(QUERIES["take_newest"](spark, SMALL))


def test_counts_are_combined_before_the_shuffle(spark):
    text = plan(QUERIES["sliding_count"](spark, SMALL))
    assert text.count("partial_count(1)") == 1 and "functions=[partial_sum" in text
    assert text.index("Generate explode") < text.index("partial_count(1)")  # counts are spread, rows are not


def test_trend_needs_no_shuffle_of_its_own(spark):
    dense = QUERIES["dense_counts"](spark, SMALL)
    assert plan(trend_summary(dense, ["user_id"])).count("Exchange") == plan(dense).count("Exchange")


def test_report_scans_once(spark):
    assert plan(QUERIES["stats_report"](spark, SMALL)).count("Scan parquet") == 1


@pytest.mark.parametrize("partitions", ["1", "200"])
def test_partition_count_does_not_change_results(spark, conf, partitions):
    def results():
        logs = events_logs(spark, SMALL)
        keys = ["event_type", "user_id"]
        points = ser.count_over_time(logs.repartition(13), keys, "24h", start="2024-01-01", end="2024-01-31")
        dense = ser.dense_grid(points, keys, "24h", "2024-01-01", "2024-01-31")
        ranked = rank_series(trend_summary(dense, keys, step="24h"), ["event_type"], ["user_id"], salts=5)
        scoped = logs.withColumn("t", F.col("labels")["event_type"])
        return rows(ranked), rows(top_patterns(scoped.repartition(7), ["t"], k=3)), rows(label_distribution(scoped, ["t"]))

    first = results()
    conf("spark.sql.shuffle.partitions", partitions)
    conf("spark.sql.adaptive.enabled", "false")
    assert results() == first


def test_session_zone_is_put_right(spark, conf):
    conf("spark.sql.session.timeZone", "America/New_York")
    assert QUERIES["nano_times"](spark, SMALL).where("ts_ns = unix_micros(cast(ts as timestamp)) * 1000").count() == 1000
