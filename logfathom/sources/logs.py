"""Log tables: ``id BIGINT, ts TIMESTAMP_NTZ, line STRING, labels MAP<STRING,STRING>`` and any scope columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def logs_view(
    df: DataFrame, *, ts: str | Column, line: str | Column, labels: dict[str, Column], id: str | Column, **extra: Column
) -> DataFrame:
    """Shape any table as logs.

    Labels given as columns stay columns to the optimizer: ``labels['k']`` on the
    map built here resolves to the column, so label filters reach the scan.
    """
    pairs = [x for name, value in labels.items() for x in (F.lit(name), value.cast("string"))]
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    columns = [as_col(id).alias("id"), as_col(ts).alias("ts"), as_col(line).alias("line")]
    return df.select(*columns, F.create_map(*pairs).alias("labels"), *[c.alias(n) for n, c in extra.items()])


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Logs written by ``write_logs`` (or any Parquet table of that shape)."""
    return spark.read.parquet(path)


def write_logs(logs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Partition by day so that time-bounded scans read only the days they need."""
    by_day = logs.withColumn("day", F.to_date("ts"))
    by_day.write.partitionBy("day").mode(mode).parquet(path)


def event_message(event_type: Column, event_id: Column, user_id: Column) -> Column:
    told = F.when(event_type == "signup", " started").when(event_type == "purchase", " slow").when(event_type == "error", " timeout")
    return F.concat(
        event_type, told.otherwise(""), F.lit(" for item "), (event_id + 100000).cast("string"),
        F.lit(" on node "), F.pmod(user_id, F.lit(7)).cast("string"),
        F.lit(" from 10.0."), F.pmod(user_id, F.lit(200)).cast("string"),
        F.lit("."), F.pmod(event_id, F.lit(250)).cast("string"), F.lit(":5432 after 30000ms"),
    )


def events_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as logs in four line shapes: JSON, logfmt, plain text, nested JSON."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    event_id, user = F.col("event_id"), F.col("user_id")
    text = event_message(F.col("event_type"), event_id, user)
    status = F.pmod(event_id, F.lit(600)).cast("string")
    shape = F.pmod(event_id, F.lit(4))
    line = (
        F.when(shape == 0, F.concat(F.lit('{"status":'), status, F.lit(',"msg":"'), text, F.lit('\\n"}')))
        .when(shape == 1, F.concat(F.lit('level=info msg="'), text, F.lit('" user_id='), user.cast("string")))
        .when(shape == 2, text)
        .otherwise(F.concat(F.lit('{"error":{"message":"'), text, F.lit('"},"status":'), status, F.lit("}")))
    )
    labels = {"event_type": F.col("event_type"), "user_id": user}
    return logs_view(events, ts="ts", line=line, labels=labels, id=event_id)


def orders_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders table as plain-text logs labelled by status and priority."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    line = F.concat(
        F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" moved to "), F.col("o_orderstatus"),
        F.lit(" at "), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"),
    )
    labels = {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority")}
    return logs_view(orders, ts="o_orderdate", line=line, labels=labels, id="o_orderkey")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines, numbered from 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
