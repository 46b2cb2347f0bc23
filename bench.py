"""Time the headline queries: one warm-up, then the median of BENCH_RUNS runs. Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from logfathom.catalog import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = (
    "log_select_errors", "line_regex_select", "take_newest", "sample_logs", "extract_message", "top_error_patterns",
    "top_patterns_by_scope", "label_values", "label_distribution", "count_over_time", "sliding_count", "topk_series",
    "dense_counts", "downsample", "trend_summaries", "series_rank_rescue", "omitted_series_keys", "auto_widen",
    "rows_in_windows", "time_expressions", "redact_documents", "redact_pages", "ingest_streams", "logs_report",
    "stats_report", "period_compare", "recurrence", "severity",
)


def timed(spark: SparkSession, name: str) -> float:
    begun = time.perf_counter()
    QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begun


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("logfathom-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        timed(spark, name)
        seconds[name] = round(statistics.median(timed(spark, name) for _ in range(RUNS)), 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
