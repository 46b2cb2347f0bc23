"""One query per operator, each over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logfathom.functions.clock import ntz_to_nanos, nanos_to_ntz
from logfathom.functions.redaction import luhn_valid, redact_columns
from logfathom.functions.text import cap_line, cut_bytes, series_key
from logfathom.functions.timeexpr import minute_of_day, resolve_time, step_minutes
from logfathom.operators import labels as lab
from logfathom.operators import select as sel
from logfathom.operators import series as ser
from logfathom.operators import windows as win
from logfathom.operators.patterns import count_patterns, top_patterns, with_pattern
from logfathom.operators.ranking import evidence_points, omitted_series, rank_series, reported_series
from logfathom.operators.trend import trend_summary
from logfathom.plans import recipes, reports, requests
from logfathom.session import prepare, shared_dir
from logfathom.sources import payloads
from logfathom.sources.logs import document_lines, events_logs, orders_logs
from logfathom.streaming.counts import streaming_count_over_time

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

START, END = "2024-01-01 00:00:00", "2024-01-31 00:00:00"
MIDDLE = "2024-01-16 00:00:00"


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return run


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _dealt(df: DataFrame) -> DataFrame:
    """The rows dealt to all cores in turn, however few row groups their files have: for long work on short rows."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism))


def _by_type(logs: DataFrame) -> DataFrame:
    return logs.withColumn("event_type", F.col("labels")["event_type"])


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.select_logs(events_logs(spark, sf_dir), [("event_type", "=", "error")])


# --- selection -------------------------------------------------------------


@query
def log_select_errors(spark, sf_dir):
    """Label matchers, chained substrings, half-open time bounds."""
    found = sel.select_logs(
        events_logs(spark, sf_dir), [("event_type", "=", "error")], contains=["node 3", "10.0."], excludes=["10.0.17."],
        start="2024-01-05 00:00:00", end="2024-01-20 00:00:00",
    )
    return found.select("id", "ts", "line", sel.label("event_type").alias("event_type"))


@query
def label_matchers(spark, sf_dir):
    """= != =~ !~, anchored, with an absent label equal to ''."""
    matchers = [("event_type", "!=", "view"), ("user_id", "=~", "[0-9]{2}"), ("user_id", "!~", "1.*|2"), ("level", "=", "")]
    found = sel.select_logs(events_logs(spark, sf_dir), matchers)
    return found.select("id", sel.label("event_type").alias("event_type"), sel.label("user_id").alias("user_id"))


@query
def default_selector(spark, sf_dir):
    """no matchers means every row that carries the default label."""
    found = sel.select_logs(orders_logs(spark, sf_dir), default_label="priority")
    return found.groupBy(sel.label("priority").alias("priority")).agg(F.count("*").alias("n"))


@query
def line_regex_select(spark, sf_dir):
    """Regex filters and a numeric JSON field filter."""
    found = sel.select_logs(
        events_logs(spark, sf_dir), [("event_type", "=~", "error|click")], regex=["(?i)NODE [0-3] "], not_regex=[r"from 10\.0\.1"],
        json=[("status", ">=", 300)],
    )
    return found.select("id", "ts", "line")


@query
def count_selected(spark, sf_dir):
    """A1: matched rows, rows returned under the limit, truncated flag."""
    logs = events_logs(spark, sf_dir).select("*", sel.label("user_id").alias("user_id"))
    return sel.count_selected(logs, ["user_id"], limit=70)


@query
def take_newest(spark, sf_dir):
    """K1 K2: the newest rows of the whole selection."""
    return sel.take_logs(_errors(spark, sf_dir), limit=50).select("id", "ts", "line")


@query
def take_oldest_by_scope(spark, sf_dir):
    """K1 K2 per scope, oldest first."""
    rows = sel.take_logs(_by_type(events_logs(spark, sf_dir)), limit=20, direction="forward", scope=["event_type"])
    return rows.select("event_type", "rank", "id", "ts")


@query
def sample_logs(spark, sf_dir):
    """Five newest rows per user."""
    logs = events_logs(spark, sf_dir).select("*", sel.label("user_id").alias("user_id"))
    return sel.sample_logs(logs, ["user_id"]).select("user_id", "rank", "id", "ts", "line")


# --- text ------------------------------------------------------------------


@query
def extract_message(spark, sf_dir):
    """The message inside JSON, logfmt and plain lines."""
    return with_pattern(events_logs(spark, sf_dir)).select("id", "message")


@query
def message_signature(spark, sf_dir):
    """Volatile parts masked."""
    return with_pattern(orders_logs(spark, sf_dir)).select("id", "pattern")


@query
def document_signatures(spark, sf_dir):
    """P3 P6 on multilingual lines with accents beside digits."""
    lines = document_lines(spark, sf_dir)
    return with_pattern(lines).select("doc_id", "line_no", "pattern")


@query
def cap_long_lines(spark, sf_dir):
    """Whole documents cut at a byte count without splitting a character."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", cap_line(F.col("text")).alias("capped"), cut_bytes(F.col("text"), 203).alias("short"))


@query
def series_keys(spark, sf_dir):
    """Display key of each label set."""
    keyed = events_logs(spark, sf_dir).select(series_key(F.col("labels")).alias("series"))
    return keyed.groupBy("series").agg(F.count("*").alias("n"))


@query
def nano_times(spark, sf_dir):
    """Timestamps to nanosecond epochs and back."""
    stamped = _events(spark, sf_dir).select("event_id", ntz_to_nanos(F.col("ts")).alias("ts_ns"))
    return stamped.select("event_id", "ts_ns", nanos_to_ntz(F.col("ts_ns").cast("string")).alias("ts"))


# --- patterns --------------------------------------------------------------


@query
def top_error_patterns(spark, sf_dir):
    """A2 A3 A4 K4: the flagship report, ten commonest patterns among errors."""
    return top_patterns(_errors(spark, sf_dir))


@query
def top_patterns_by_scope(spark, sf_dir):
    """A2 A3 A4 K4 for every order status at once, first message in forward order."""
    logs = orders_logs(spark, sf_dir).withColumn("status", sel.label("status"))
    return top_patterns(logs, ["status"], k=5, direction="forward")


@query
def pattern_counts(spark, sf_dir):
    """A2 without the cap."""
    return count_patterns(events_logs(spark, sf_dir)).select("pattern", "count")


# --- labels ----------------------------------------------------------------


@query
def label_names(spark, sf_dir):
    """A5 F7 S6."""
    return lab.label_names(sel.between(events_logs(spark, sf_dir), START, END))


@query
def label_values(spark, sf_dir):
    """Values containing a text, capped, with totals."""
    return lab.label_values(events_logs(spark, sf_dir), "user_id", contains="1", limit=10)


@query
def label_values_of_selection(spark, sf_dir):
    """Values of one label within a stream selection and a time range, per event type."""
    logs = sel.select_logs(events_logs(spark, sf_dir), [("event_type", "=~", "error|view")], start=START, end=MIDDLE)
    return lab.label_values(_by_type(logs), "user_id", ["event_type"])


@query
def label_distribution(spark, sf_dir):
    """Commonest values of every label."""
    return lab.label_distribution(events_logs(spark, sf_dir))


@query
def label_distribution_by_scope(spark, sf_dir):
    """A7 per day."""
    logs = events_logs(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return lab.label_distribution(logs, ["day"], top=3)


# --- series ----------------------------------------------------------------


@query
def count_over_time(spark, sf_dir):
    """Hourly counts per event type."""
    return ser.count_over_time(events_logs(spark, sf_dir), ["event_type"], "1h", start=START, end=END)


@query
def sliding_count(spark, sf_dir):
    """A8 with a range longer than the step."""
    return ser.count_over_time(events_logs(spark, sf_dir), ["event_type"], "1h", range_="3h", start=START, end=MIDDLE)


@query
def uneven_sliding_count(spark, sf_dir):
    """A8 with a range that is no multiple of the step."""
    return ser.count_over_time(events_logs(spark, sf_dir), ["event_type"], "1h", range_="90m")


@query
def rate_over_time(spark, sf_dir):
    """Per-second rate."""
    points = ser.count_over_time(events_logs(spark, sf_dir), ["event_type"], "5m", range_="5m", start=START, end=END)
    return ser.rate(points, "5m")


@query
def sum_over_series(spark, sf_dir):
    """A10: per-user counts summed by event type, and over everything."""
    points = ser.count_over_time(events_logs(spark, sf_dir), ["event_type", "user_id"], "6h", start=START, end=END)
    by_type = ser.sum_by(points, ["event_type"])
    overall = ser.sum_by(points).select(F.lit("total").alias("event_type"), "ts", "value")
    return by_type.unionByName(overall)


@query
def instant_counts(spark, sf_dir):
    """Counts of the last six hours at one instant."""
    return ser.instant_counts(events_logs(spark, sf_dir), ["user_id"], "2024-01-20 12:00:00", "6h")


@query
def topk_series(spark, sf_dir):
    """K5: the three busiest users at each six-hour point."""
    points = ser.count_over_time(events_logs(spark, sf_dir), ["user_id"], "6h", start=START, end=END)
    return ser.topk_series(points, 3, keys=["user_id"]).select("ts", "rank", "user_id", "value")


def _daily_users(spark, sf_dir, keys=("user_id",)):
    logs = events_logs(spark, sf_dir)
    points = ser.count_over_time(logs, list(keys), "24h", start=START, end=END)
    return ser.dense_grid(points, list(keys), "24h", START, END)


@query
def dense_counts(spark, sf_dir):
    """A8 on a zero-filled grid."""
    return _daily_users(spark, sf_dir)


@query
def downsample(spark, sf_dir):
    """K9: hourly series cut to 24 points."""
    logs = events_logs(spark, sf_dir)
    points = ser.count_over_time(logs, ["event_type"], "1h", start=START, end=END)
    return ser.downsample(ser.dense_grid(points, ["event_type"], "1h", START, END)).select("event_type", "ts", "value", "idx")


@query
def trend_summaries(spark, sf_dir):
    """Every user's daily counts."""
    return trend_summary(_daily_users(spark, sf_dir), ["user_id"], step="24h")


@query
def trend_of_values(spark, sf_dir):
    """A11-A13 P8 on text samples of irregular series, some of them not numbers."""
    bad = F.pmod(F.col("event_id"), F.lit(11))
    text = F.when(bad == 0, "NaN").when(bad == 1, "+Inf").when(bad == 2, "n/a").otherwise(F.col("value").cast("string"))
    points = _events(spark, sf_dir).select("user_id", "ts", text.alias("value"))
    return trend_summary(points, ["user_id"], step="1d")


@query
def series_rank_rescue(spark, sf_dir):
    """K6 K7: reported series per event type, anomalous ones rescued."""
    keys = ["event_type", "user_id"]
    summaries = trend_summary(_daily_users(spark, sf_dir, keys), keys, step="24h")
    kept = reported_series(rank_series(summaries, ["event_type"], ["user_id"]))
    return kept.select("event_type", "user_id", "total", "anomaly", "report_rank", "volume_rank", "total_series", "anomalous_series")


@query
def omitted_series_keys(spark, sf_dir):
    """What the report leaves out, per event type."""
    keys = ["event_type", "user_id"]
    summaries = trend_summary(_daily_users(spark, sf_dir, keys), keys, step="24h")
    left = omitted_series(rank_series(summaries, ["event_type"], ["user_id"]), ["event_type"], "user_id")
    joined = [F.array_join(c, ",").alias(c) for c in ("omitted_keys", "omitted_anomalous_keys")]
    return left.select("event_type", "total_series", "omitted_series", "omitted_anomalous", *joined)


@query
def report_points(spark, sf_dir):
    """K8 K9: down-sampled points of the first five reported series."""
    dense = _daily_users(spark, sf_dir)
    ranked = rank_series(trend_summary(dense, ["user_id"], step="24h"), [], ["user_id"])
    return evidence_points(dense, ranked, ["user_id"]).select("user_id", "report_rank", "ts", "value")


# --- time windows ----------------------------------------------------------


def _expressions(spark, sf_dir) -> DataFrame:
    """One time expression per event, its form picked by the event id, relative to the event's time."""
    e = _events(spark, sf_dir)
    n = F.pmod(F.col("user_id"), F.lit(50)) + 1
    hour, minute = F.pmod(F.col("user_id"), F.lit(24)), F.lpad(F.pmod(n, F.lit(60)).cast("string"), 2, "0")
    ns = ntz_to_nanos(F.col("ts")).cast("string")

    def text(*parts) -> Column:
        return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])

    forms = [
        text("now"), text(n, "h ago"), text(n, " minutes"), text("last ", n, " days"), text("Yesterday"),
        text("yesterday at ", hour, ":", minute), text("yesterday at ", F.pmod(hour, F.lit(12)) + 1, "pm"),
        text("this morning"), text("last month"), text("today at noon"), text(n, "h", minute, "m"), text("1.5h"),
        F.date_format("ts", "yyyy-MM-dd't'HH:mm:ss.SSS'z'"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+02:00'"),
        ns, text("soon"), text("  "), text("last night"), text("-5m"), text("midnight"),
    ]
    kind = F.pmod(F.col("event_id"), F.lit(len(forms)))
    expr = F.lit(None).cast("string")
    for i, form in reversed(list(enumerate(forms))):
        expr = F.when(kind == i, form).otherwise(expr)
    return e.select("event_id", F.col("ts").alias("as_of"), expr.alias("expr"))


@query
def time_expressions(spark, sf_dir):
    """Expressions resolved against a column."""
    return _expressions(spark, sf_dir).select("event_id", "expr", resolve_time(F.col("expr"), F.col("as_of")).alias("resolved"))


@query
def times_of_day(spark, sf_dir):
    """Clock texts from the events' own numbers."""
    e = _events(spark, sf_dir)
    hour, minute = F.pmod(F.col("user_id"), F.lit(30)), F.pmod(F.col("event_id"), F.lit(70))
    half = F.pmod(F.col("event_id"), F.lit(3))
    suffix = F.when(half == 0, " am").when(half == 1, "PM").otherwise("")
    text = F.lower(F.concat(hour.cast("string"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0"), suffix))
    return e.select("event_id", text.alias("clock"), minute_of_day(text).cast("bigint").alias("minute_of_day"))


@query
def range_repair(spark, sf_dir):
    """Windows around each event repaired, with warning codes and the automatic step."""
    e = _events(spark, sf_dir)
    start_h = F.when(F.pmod("event_id", F.lit(13)) == 0, F.lit(-960)).otherwise((F.pmod("event_id", F.lit(7)) - 3) * 5)
    end_h = F.pmod("event_id", F.lit(11)) - 5
    shift = lambda h: F.col("ts") + F.make_dt_interval(hours=h.cast("int"))
    raw = e.select("event_id", F.col("ts").alias("as_of"), shift(start_h).alias("start_ts"), shift(end_h).alias("end_ts"))
    fixed = win.with_step(win.repair_window(raw, max_hours=win.MAX_RANGE_HOURS).withColumn("step", F.lit("")))
    codes = F.array_join("warnings", ",")
    return fixed.select("event_id", "start_ts", "end_ts", codes.alias("warnings"), "step", step_minutes(F.col("step")).alias("step_minutes"))


@query
def resolved_windows(spark, sf_dir):
    """Free-text bounds with defaults, resolved and repaired."""
    asked = _expressions(spark, sf_dir).select("event_id", "as_of", F.col("expr").alias("start_expr"), F.lit("").alias("end_expr"))
    fixed = win.repair_window(win.resolve_window(asked, hours_back=win.LABEL_HOURS), max_hours=win.MAX_RANGE_HOURS)
    return fixed.select("event_id", "start_ts", "end_ts", "start_given", F.array_join("warnings", ",").alias("warnings"))


def _requests(spark, sf_dir) -> DataFrame:
    """One request per user and active day, asking for the hour before 12:30."""
    days = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("user_id"), F.to_date("ts").alias("day")).distinct()
    end = F.col("day").cast("timestamp_ntz") + F.expr("INTERVAL '12:30' HOUR TO MINUTE")
    asked = days.select(
        F.concat_ws("/", "user_id", F.col("day").cast("string")).alias("request_id"), "user_id", end.alias("end_ts"),
        (end - F.expr("INTERVAL '1' HOUR")).alias("start_ts"), (F.dayofmonth("day") % 5 == 0).alias("start_given"),
    )
    return asked


@query
def auto_widen(spark, sf_dir):
    """Empty default windows widened to the first rung with rows, the step picked again."""
    logs = events_logs(spark, sf_dir).select("ts", sel.label("user_id").alias("user_id"))
    widened = win.result_warning(win.auto_widen(logs, _requests(spark, sf_dir), ["user_id"], max_hours=win.MAX_RANGE_HOURS))
    stepped = win.with_step(widened.withColumn("start_ts", F.col("used_start")).withColumn("step", F.lit("")))
    return stepped.select("request_id", "used_start", "widened", "has_rows", "last_ts", "warning", "step")


@query
def rows_in_windows(spark, sf_dir):
    """What each user did in the hour after each of their errors."""
    logs = _by_type(events_logs(spark, sf_dir)).withColumn("user_id", sel.label("user_id"))
    errors = logs.where(F.col("event_type") == "error")
    windows = errors.select(
        F.col("id").alias("error_id"), "user_id", F.col("ts").alias("start_ts"), (F.col("ts") + F.expr("INTERVAL '1' HOUR")).alias("end_ts")
    )
    pairs = win.rows_in_windows(logs.select("id", "ts", "user_id"), windows, ["user_id"])
    return pairs.groupBy("error_id").agg(F.count("*").alias("rows"), F.max("ts").alias("last_ts"))


# --- redaction -------------------------------------------------------------


@query
def redact_documents(spark, sf_dir):
    """R1-R10 over whole documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return redact_columns(docs, "text", "hits")


@query
def redact_pages(spark, sf_dir):
    """R1-R10 over raw pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.col("html").alias("text"))
    return redact_columns(pages, "text", "hits")


@query
def redact_conversations(spark, sf_dir):
    """R1-R10 over conversation turns."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    return redact_columns(turns, "text", "hits")


@query
def redact_orders(spark, sf_dir):
    """R1-R10 on contact lines put together from order columns, so that every stage meets many rows."""
    o = _dealt(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey"))
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    digits = lambda c, width: F.lpad(F.pmod(c, F.lit(10**width)).cast("string"), width, "0")
    card = F.concat_ws("-", F.lit("4111"), digits(key, 4), digits(cust, 4), digits(key + cust, 4))
    amex = F.concat(F.lit("3782"), digits(key, 6), digits(cust * 7, 5))
    ip = F.concat_ws(".", *[F.pmod(c, F.lit(256)).cast("string") for c in (key, cust, key + 1, cust + 1)])
    text = F.concat(
        F.lit("mail c"), cust.cast("string"), F.lit("@shop.example.com ssn "), digits(key, 3), F.lit("-12-"), digits(cust, 4),
        F.lit(" card "), card, F.lit(" or "), amex, F.lit(" at "), ip,
        F.lit(" Bearer tok"), key.cast("string"), F.lit(" eyJh"), key.cast("string"), F.lit(".eyJp"), cust.cast("string"), F.lit(".sig"),
    )
    return redact_columns(o.select("o_orderkey", text.alias("text")), "text", "hits")


@query
def luhn_checks(spark, sf_dir):
    """R8 on 13-digit numbers made from order columns."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    number = F.concat(F.lit("62"), F.lpad("o_orderkey", 6, "0"), F.lpad("o_custkey", 5, "0"))
    return o.select("o_orderkey", number.alias("number")).withColumn("valid", luhn_valid("number"))


# --- payloads --------------------------------------------------------------


def _stream_payloads(spark, sf_dir) -> DataFrame:
    """Event rows packed into stream payloads of at most 100 rows, some tuples short or with a bad time."""
    logs = _by_type(events_logs(spark, sf_dir)).withColumn("chunk", F.floor(F.col("id") / 100))
    ns = ntz_to_nanos(F.col("ts")).cast("string")
    bad = F.pmod("id", F.lit(50))
    pair = F.when(bad == 0, F.array(ns)).when(bad == 1, F.array(F.lit("12x"), "line")).otherwise(F.array(ns, F.col("line")))
    streams = logs.groupBy("chunk", "event_type").agg(F.collect_list(pair).alias("values"))
    stream = F.struct(F.create_map(F.lit("event_type"), F.col("event_type")).alias("stream"), "values")
    return _packed(streams, stream, "streams")


def _packed(rows: DataFrame, entry: Column, kind: str) -> DataFrame:
    data = F.struct(F.lit(kind).alias("resultType"), F.collect_list(entry).alias("result"))
    return rows.groupBy("chunk").agg(F.to_json(F.struct(F.lit("success").alias("status"), data.alias("data"))).alias("payload"))


@query
def ingest_streams(spark, sf_dir):
    """Stream payloads to log rows."""
    rows = payloads.stream_rows(_stream_payloads(spark, sf_dir), keep=["chunk"])
    return rows.select("chunk", "ts_ns", "ts", "line", F.col("labels")["event_type"].alias("event_type"))


def _sample_pair() -> Column:
    seconds = F.concat(F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"), F.lit(".25"))
    return F.array(seconds, F.col("value").cast("string"))


@query
def ingest_matrix(spark, sf_dir):
    """S3: range results to points."""
    e = _events(spark, sf_dir).withColumn("chunk", F.floor(F.col("event_id") / 100))
    series = e.groupBy("chunk", "user_id").agg(F.collect_list(_sample_pair()).alias("values"))
    metric = F.struct(F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("metric"), "values")
    points = payloads.matrix_points(_packed(series, metric, "matrix"), keep=["chunk"])
    return points.select("chunk", F.col("labels")["user"].alias("user"), "ts", "value")


@query
def ingest_vector(spark, sf_dir):
    """Instant results to one-point series."""
    e = _events(spark, sf_dir).withColumn("chunk", F.floor(F.col("event_id") / 100))
    metric = F.struct(F.create_map(F.lit("id"), F.col("event_id").cast("string")).alias("metric"), _sample_pair().alias("value"))
    points = payloads.vector_points(_packed(e, metric, "vector"), keep=["chunk"])
    return points.select("chunk", F.col("labels")["id"].alias("id"), "ts", "value")


@query
def payload_emptiness(spark, sf_dir):
    """Which payloads hold no rows; every third is emptied, every seventh broken, every fifth of unknown kind."""
    packed = _stream_payloads(spark, sf_dir)
    chunk = F.col("chunk")
    text = (
        F.when(F.pmod(chunk, F.lit(3)) == 0, F.lit('{"data":{"resultType":"matrix","result":[{"metric":{},"values":[]}]}}'))
        .when(F.pmod(chunk, F.lit(7)) == 0, F.concat(F.lit("{"), F.col("payload")))
        .when(F.pmod(chunk, F.lit(5)) == 0, F.regexp_replace("payload", '"streams"', '"other"'))
        .otherwise(F.col("payload"))
    )
    return packed.select("chunk", payloads.payload_empty(text).alias("is_empty"))


@query
def payload_rejects(spark, sf_dir):
    """Every record of stream payloads accounted for; some are null, broken, of another kind or wrongly shaped."""
    packed = _stream_payloads(spark, sf_dir)
    bad = F.pmod("chunk", F.lit(10))
    text = (
        F.when(bad == 3, F.lit(None).cast("string"))
        .when(bad == 4, F.concat(F.lit("{"), F.col("payload")))
        .when(bad == 5, F.regexp_replace("payload", '"streams"', '"matrix"'))
        .when(bad == 6, F.lit('{"data":{"resultType":"streams","result":"oops"}}'))
        .when(bad == 7, F.lit('{"data":{"resultType":"streams","result":[{"stream":{"a":"b"},"values":5},7,{"stream":[1],"values":[]}]}}'))
        .otherwise(F.col("payload"))
    )
    found = payloads.records(packed.select("chunk", text.alias("payload")), payloads.STREAMS, keep=["chunk"])
    return found.groupBy("chunk", F.coalesce("reason", F.lit("good")).alias("outcome")).agg(F.count("*").alias("n"))


# --- reports ---------------------------------------------------------------


@query
def logs_report(spark, sf_dir):
    """A redacted report per event type; the fields shown are read back from its JSON."""
    out = reports.logs_report(_by_type(events_logs(spark, sf_dir)), ["event_type"], limit=100)
    read = lambda path: F.get_json_object("report", path)
    return out.select(
        "event_type", "matched", "total_patterns", "form",
        read("$.total_logs").alias("total_logs"), read("$.truncated").alias("truncated"),
        read("$.top_patterns[0].pattern").alias("first_pattern"), read("$.top_patterns[0].pct").alias("first_pct"),
        read("$.logs[4].timestamp").alias("fifth_time"), F.json_array_length(read("$.logs")).alias("sample_rows"),
        F.size(F.json_object_keys(read("$.unique_labels.user_id"))).alias("user_values"),
    )


@query
def stats_report(spark, sf_dir):
    """B2: a statistics report per event type over daily user series."""
    keys = ["event_type", "user_id"]
    out = reports.stats_report(_daily_users(spark, sf_dir, keys), ["user_id"], ["event_type"], step="24h")
    read = lambda path: F.get_json_object("report", path)
    return out.select(
        "event_type", "total_series", "omitted_series", "omitted_anomalous", "form",
        F.size(F.json_object_keys(read("$.summaries"))).alias("summaries"),
        F.json_array_length(read("$.series")).alias("series"),
        F.json_array_length(read("$.series[0].values")).alias("first_points"),
        read("$.series[0].labels.user_id").alias("first_user"),
        F.json_array_length(read("$.omitted_series_keys")).alias("omitted_listed"),
    )


@query
def label_values_report(spark, sf_dir):
    """Label values as a report."""
    out = reports.label_values_report(_by_type(events_logs(spark, sf_dir)), "user_id", ["event_type"], contains="1", limit=5)
    values = F.get_json_object("report", "$.values")
    return out.select("event_type", "total_values", "total_label_values", "truncated", values.alias("values"))


@query
def shrunk_reports(spark, sf_dir):
    """Reports per user over a tight budget lose raw rows and label values, never their patterns."""
    logs = events_logs(spark, sf_dir).select("*", sel.label("user_id").alias("user_id"))
    out = reports.logs_report(logs, ["user_id"], limit=100, budget=1_500)
    patterns = F.json_array_length(F.get_json_object("report", "$.top_patterns"))
    fits = F.octet_length("report") <= 1_500
    return out.select("user_id", "matched", "form", fits.alias("within_budget"), patterns.alias("patterns"))


@query
def oversized_notices(spark, sf_dir):
    """A budget that not even the patterns fit leaves a small notice with the size."""
    logs = events_logs(spark, sf_dir).select("*", sel.label("user_id").alias("user_id"))
    out = reports.logs_report(logs, ["user_id"], limit=100, budget=150)
    read = lambda path: F.get_json_object("report", path)
    larger = read("$.original_bytes").cast("bigint") > 150
    return out.select("user_id", "matched", "form", read("$.truncated").alias("truncated"), larger.alias("larger"))


def _asked_reports(spark, sf_dir) -> DataFrame:
    """One request per user: default, reversed, future, empty, overlong, hopeless and unreadable windows, selections as data."""
    u = F.col("user_id")
    users = _events(spark, sf_dir).select("user_id").distinct()
    as_of = F.lit("2024-01-20 12:30:00").cast("timestamp_ntz") + F.make_dt_interval(days=F.pmod(u, F.lit(5)).cast("int"))
    kind = F.pmod(u, F.lit(7))
    start = F.when(kind == 1, "now").when(kind == 2, "2 days ago").when(kind == 3, "now").when(kind == 4, "last 60 days").when(kind == 6, "some time")
    ahead = F.date_format(as_of + F.expr("INTERVAL '3' DAY"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    end = F.when(kind == 1, "48h ago").when(kind == 2, ahead).when(kind == 3, "now")
    one = lambda name, op, value: F.struct(F.lit(name).alias("name"), F.lit(op).alias("op"), value.alias("value"))
    exact, regex = one("user_id", "=", u.cast("string")), one("user_id", "=~", F.concat(u.cast("string"), F.lit("|none")))
    matchers = F.array(F.when(u < 3, regex).otherwise(exact), one("event_type", "!=", F.lit("view")))
    contains = F.when(kind == 5, F.array(F.lit("no such text"))).otherwise(F.array(F.lit("node "), F.lit("10.0.")))
    return users.select(
        u.alias("request_id"), as_of.alias("as_of"), start.alias("start_expr"), end.alias("end_expr"), matchers.alias("matchers"),
        contains.alias("contains"), F.array(F.lit("(?i)NODE [0-6] ")).alias("regex"), F.array(F.lit("node 9")).alias("excludes"),
        (F.pmod(u, F.lit(40)) + 1).alias("limit"), F.when(u % 2 == 0, "forward").alias("direction"), F.array(F.lit("event_type")).alias("group_by"),
        F.when(u % 3 == 1, "6h").when(u % 3 == 2, "often").alias("step"),
    )


@query
def request_logs_reports(spark, sf_dir):
    """A table of requests answered in one pass, what was repaired and widened said inside."""
    out = requests.logs_reports(events_logs(spark, sf_dir), _asked_reports(spark, sf_dir), max_hours=win.MAX_RANGE_HOURS)
    read = lambda path: F.get_json_object("report", path)
    inside = F.from_json("report", "struct<warnings: array<string>>")["warnings"]
    return out.select(
        "request_id", "used_start", "end_ts", "matched", "total_patterns", F.coalesce(F.array_join(inside, ","), F.lit("")).alias("codes"),
        read("$.total_logs").alias("total_logs"), read("$.truncated").alias("truncated"), read("$.direction").alias("direction"),
        read("$.time_range").alias("time_range"), read("$.top_patterns[0].pattern").alias("first_pattern"), read("$.logs[0].timestamp").alias("first_time"),
    )


@query
def request_stats_reports(spark, sf_dir):
    """Statistics for a table of requests, each with its own window and step."""
    out = requests.stats_reports(events_logs(spark, sf_dir), _asked_reports(spark, sf_dir), max_hours=win.MAX_RANGE_HOURS)
    shape = "struct<warnings: array<string>, summaries: map<string, struct<total: double, peak: double>>>"
    read = F.from_json("report", shape)
    sums = F.map_values(read["summaries"])
    return out.select(
        "request_id", "used_start", "end_ts", "step", "total_series", F.coalesce(F.array_join(read["warnings"], ","), F.lit("")).alias("codes"),
        F.aggregate(sums, F.lit(0.0), lambda a, x: a + x["total"]).alias("total"),
        F.coalesce(F.array_max(F.transform(sums, lambda x: x["peak"])), F.lit(0.0)).alias("peak"),
        F.get_json_object("report", "$.series[0].labels.event_type").alias("first_type"),
        F.get_json_object("report", "$.time_range").alias("time_range"),
    )


@query
def request_label_names(spark, sf_dir):
    """Label names of each user's own window of days, per request."""
    found = requests.label_names_reports(events_logs(spark, sf_dir), _asked_reports(spark, sf_dir))
    return found.select("request_id", F.array_join("names", ",").alias("names"), F.array_join("warnings", ",").alias("codes"))


@query
def request_label_values(spark, sf_dir):
    """Values of a label per request, filtered and capped by the request."""
    asked = _asked_reports(spark, sf_dir).withColumns(
        {"label": F.when(F.col("request_id") % 11 != 0, "user_id"), "contains_text": F.when(F.col("request_id") % 2 == 0, "1"), "limit": F.lit(3)}
    )
    found = requests.label_values_reports(events_logs(spark, sf_dir), asked)
    joined = [F.array_join(c, ",").alias(n) for c, n in (("values", "values"), ("warnings", "codes"))]
    return found.select("request_id", "total_values", "total_label_values", "truncated", *joined)


# --- recipes ---------------------------------------------------------------


@query
def error_rate(spark, sf_dir):
    """Daily errors per user, the reported series."""
    ranked = recipes.error_rate(events_logs(spark, sf_dir), [("event_type", "=", "error")], ["user_id"], step="24h", start=START, end=END)
    return reported_series(ranked).select("user_id", "total", "trend", "anomaly", "report_rank")


@query
def period_compare(spark, sf_dir):
    """First against second half of the month per user."""
    return recipes.compare_periods(events_logs(spark, sf_dir), ["user_id"], (START, MIDDLE), (MIDDLE, END))


def _hourly_types(spark, sf_dir) -> DataFrame:
    points = ser.count_over_time(events_logs(spark, sf_dir), ["event_type"], "1h", start=START, end=END)
    return ser.dense_grid(points, ["event_type"], "1h", START, END)


@query
def onset(spark, sf_dir):
    """First hour in which a type leaves its baseline."""
    return recipes.onset(_hourly_types(spark, sf_dir), ["event_type"], factor=2.0, history=24)


@query
def service_health(spark, sf_dir):
    """C4: volume and errors of every user ever seen, in one day."""
    logs = events_logs(spark, sf_dir)
    known = logs.select(sel.label("user_id").alias("user_id"))
    error = F.col("labels")["event_type"] == "error"
    return recipes.service_health(logs, known, "user_id", error, start="2024-01-20 00:00:00", end="2024-01-20 12:00:00")


@query
def silent_services(spark, sf_dir):
    """Users active before and absent in the last day."""
    return recipes.silent_series(events_logs(spark, sf_dir), ["user_id"], start=START, since="2024-01-30 00:00:00", end=END)


@query
def restart_gaps(spark, sf_dir):
    """Hours without rows between active hours, per event type."""
    points = ser.count_over_time(events_logs(spark, sf_dir), ["event_type"], "30m", start=START, end=END)
    return recipes.restart_gaps(points, ["event_type"], "30m")


@query
def blast_radius(spark, sf_dir):
    """Distinct users per event type."""
    return recipes.blast_radius(_by_type(events_logs(spark, sf_dir)), "user_id", ["event_type"])


@query
def recurrence(spark, sf_dir):
    """Bursts of every pattern and the time between them."""
    return recipes.recurrence(events_logs(spark, sf_dir), gap="8h")


@query
def deploy_correlation(spark, sf_dir):
    """Deployment-like rows within half an hour of each onset."""
    onsets = recipes.onset(_hourly_types(spark, sf_dir), ["event_type"], factor=2.0, history=24).select("event_type", "onset")
    deploys = recipes.deploy_lines(events_logs(spark, sf_dir)).select("id", "ts")
    return recipes.around(onsets, deploys)


@query
def timeline(spark, sf_dir):
    """Rows naming every identifier, oldest first."""
    found = recipes.timeline(events_logs(spark, sf_dir), ["node 3", "10.0.17."], failures=True)
    return found.select("id", "ts", "line")


@query
def slow_patterns(spark, sf_dir):
    """C11: patterns among rows that mention slowness."""
    return recipes.slow_patterns(events_logs(spark, sf_dir))


@query
def severity(spark, sf_dir):
    """A verdict per user from one day's health and the month's error trend."""
    logs = events_logs(spark, sf_dir)
    known = logs.select(sel.label("user_id").alias("user_id"))
    error = F.col("labels")["event_type"] == "error"
    health = recipes.service_health(logs, known, "user_id", error, start="2024-01-20 00:00:00", end=END)
    errors = ser.count_over_time(_errors(spark, sf_dir), ["user_id"], "24h", start=START, end=END)
    trends = trend_summary(ser.dense_grid(errors, ["user_id"], "24h", START, END), ["user_id"], step="24h")
    verdicts = recipes.severity(health, trends, "user_id")
    return verdicts.select("user_id", "rows", "errors", "error_share", "trend", "non_zero_pct", "verdict")


# --- streaming -------------------------------------------------------------


@query
def streaming_counts(spark, sf_dir):
    """A8 as a stream over the events file: every hour the watermark has closed."""
    schema = _events(spark, sf_dir).schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    counted = streaming_count_over_time(source, ["event_type"], "1h", late="10 minutes")
    base = f"{shared_dir(spark)}/streaming_counts_{uuid.uuid4().hex}"
    running = (
        counted.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )
    running.awaitTermination()
    return spark.read.schema(counted.schema).parquet(f"{base}/out")
