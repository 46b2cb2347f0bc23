"""Reports: one bounded JSON text per scope."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfathom.functions.redaction import redact_columns, redact_values
from logfathom.functions.text import column_key, series_key
from logfathom.operators.labels import DEFAULT_VALUES, TOP_VALUES, label_distribution, ranked_values
from logfathom.operators.patterns import MIN_ROWS, TOP_PATTERNS, top_patterns
from logfathom.operators.ranking import MAX_LISTED, MAX_RESCUED, MAX_SERIES, MAX_WITH_POINTS, omitted_columns, rank_series
from logfathom.operators.select import DEFAULT_LIMIT, SAMPLE_ROWS, check_limit, limited, newest_first, sample_logs
from logfathom.operators.series import MAX_POINTS
from logfathom.operators.trend import trend_summary

# Size budget of a report and label values left after a cut.
MAX_REPORT_BYTES = 30_000
SHRUNK_VALUES = 25


def bounded_json(df: DataFrame, full: Column, shrunk: Column, *, name: str, budget: int | None = None) -> DataFrame:
    """Add ``report``: the full JSON, or with a budget else the shrunk one, else a small notice with the size it had.

    ``size_bytes`` is the full size and ``form`` tells which of the three was taken.
    """
    staged = df.withColumn("__full", F.to_json(full))
    staged = staged.withColumn("size_bytes", F.octet_length("__full").cast("bigint"))
    if budget is None:
        return staged.withColumn("form", F.lit("full")).withColumnRenamed("__full", "report")
    staged = staged.withColumn("__shrunk", F.when(F.col("size_bytes") > budget, F.to_json(shrunk)))
    fits = F.col("size_bytes") <= budget
    cut_size = F.octet_length("__shrunk").cast("bigint")
    cut_fits = cut_size <= budget
    notice = F.to_json(
        F.struct(
            F.lit(True).alias("truncated"),
            F.lit("over_budget").alias("warning"),
            F.lit(name).alias("tool"),
            cut_size.alias("original_bytes"),
        )
    )
    report = F.when(fits, F.col("__full")).when(cut_fits, F.col("__shrunk")).otherwise(notice)
    form = F.when(fits, "full").when(cut_fits, "shrunk").otherwise("notice")
    return staged.withColumn("report", report).withColumn("form", form).drop("__full", "__shrunk")


def _stack(parts: list[DataFrame]) -> DataFrame:
    """Rows of different kinds in one table, so a report is assembled by one grouping instead of joins."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _gather(kind: str, entry: Column) -> Column:
    """Entries of one kind in rank order. Callers stack only rows that are already capped."""
    found = F.collect_list(F.when(F.col("kind") == kind, F.struct("place", entry.alias("e"))))
    return F.transform(F.array_sort(found, _by_place), lambda x: x["e"])


def _by_place(a: Column, b: Column) -> Column:
    return F.when(a["place"] < b["place"], -1).when(a["place"] > b["place"], 1).otherwise(0)


def _kind(
    df: DataFrame, scope: Sequence[str], kind: str, rank: Column, tie: Column | None = None, **columns: Column
) -> DataFrame:
    second = (F.lit("") if tie is None else tie).cast("string")
    place = F.struct(rank.cast("int").alias("rank"), second.alias("tie"))
    return df.select(*scope, F.lit(kind).alias("kind"), place.alias("place"), *[c.alias(n) for n, c in columns.items()])


def logs_parts(
    logs: DataFrame,
    scope: Sequence[str] = (),
    *,
    direction: str | Column | None = None,
    patterns_shown: int = TOP_PATTERNS,
    values_shown: int = TOP_VALUES,
    rows_shown: int = SAMPLE_ROWS,
    redact: bool = True,
) -> DataFrame:
    """What a logs report is made of, one row per scope that has rows: matched, total_patterns, patterns, values, logs."""
    patterns = top_patterns(logs, scope, k=patterns_shown, direction=direction, min_rows=0)
    values = label_distribution(logs, scope, top=values_shown)
    rows = sample_logs(logs, scope, direction=direction, n=rows_shown)
    if redact:
        patterns = redact_columns(patterns, ["pattern", "sample"])
        values = _merge_equal(redact_columns(values, "value"), scope)
        rows = redact_columns(rows.withColumn("labels", redact_values("labels")), "line")
    pattern = F.struct("pattern", "count", "pct", "sample")
    moment = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    stacked = _stack(
        [
            _kind(patterns, scope, "pattern", F.col("rank"), p=pattern, rows=F.col("total_rows"), groups=F.col("total_patterns")),
            _kind(values, scope, "value", F.col("rank"), F.concat_ws(" ", "label", "value"), v=F.struct("label", "value", "count", "omitted_values")),
            _kind(rows, scope, "row", F.col("rank"), r=F.struct(moment.alias("timestamp"), "line", "labels")),
        ]
    )
    return stacked.groupBy(*scope).agg(
        F.coalesce(F.max("rows"), F.lit(0)).alias("matched"),
        F.coalesce(F.max("groups"), F.lit(0)).alias("total_patterns"),
        _gather("pattern", F.col("p")).alias("patterns"),
        _gather("value", F.col("v")).alias("values"),
        _gather("row", F.col("r")).alias("logs"),
    )


def logs_json(
    one: DataFrame,
    scope: Sequence[str],
    *,
    limit: int | Column | None,
    direction: Column,
    codes: Column,
    min_rows: int = MIN_ROWS,
    budget: int | None = None,
) -> DataFrame:
    """The reports of ``logs_parts`` rows that also carry what was asked (``__query``, ``__range``)."""
    enough = F.col("matched") >= min_rows
    returned, truncated = limited(F.col("matched"), limit)
    one = one.withColumn("patterns", F.when(enough, F.col("patterns"))).withColumn("unique_labels", _distribution(F.col("values")))
    more = F.when(enough & (F.col("total_patterns") > F.size("patterns")), F.col("total_patterns"))
    head = [
        returned.alias("total_logs"),
        F.col("matched"),
        truncated.alias("truncated"),
        direction.alias("direction"),
        F.col("__query").alias("query_executed"),
        F.col("__range").alias("time_range"),
    ]
    body = [F.col("patterns").alias("top_patterns"), more.alias("total_patterns")]
    none = F.when(F.size(codes) > 0, codes)
    full = F.struct(*head, none.alias("warnings"), *body, F.col("unique_labels"), F.col("logs"))
    cut = F.struct(*head, F.concat(codes, F.array(F.lit("size_budget_rows_dropped"))).alias("warnings"), *body)
    out = bounded_json(one, full, cut, name="logs_report", budget=budget)
    return out.select(*scope, "matched", more.alias("total_patterns"), "size_bytes", "form", "report")


def logs_report(
    logs: DataFrame,
    scope: Sequence[str] = (),
    *,
    query: str = "",
    time_range: str = "",
    limit: int | None = DEFAULT_LIMIT,
    direction: str | None = None,
    patterns_shown: int = TOP_PATTERNS,
    min_rows: int = MIN_ROWS,
    values_shown: int = TOP_VALUES,
    rows_shown: int = SAMPLE_ROWS,
    redact: bool = True,
    budget: int | None = None,
) -> DataFrame:
    """Counts, top patterns, label distribution and sample rows of each scope, redacted, and cut only to a given budget."""
    n = check_limit(limit)
    shown = {"patterns_shown": patterns_shown, "values_shown": values_shown, "rows_shown": rows_shown}
    one = _asked(logs_parts(logs, scope, direction=direction, redact=redact, **shown), query, time_range, redact)
    codes = F.array_compact(F.array(F.when(F.col("matched") == 0, "no_rows")))
    way = F.lit("backward" if newest_first(direction) else "forward")
    return logs_json(one, scope, limit=n, direction=way, codes=codes, min_rows=min_rows, budget=budget)


def _asked(df: DataFrame, query: str | Column, time_range: str | Column, redact: bool) -> DataFrame:
    """Add what was asked; a filter may name the very person whose data the report hides."""
    asked = df.withColumn("__query", F.lit(query)).withColumn("__range", F.lit(time_range))
    return redact_columns(asked, ["__query", "__range"]) if redact else asked


def _merge_equal(values: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Values that became equal by redaction are one entry with the summed count."""
    return values.groupBy(*scope, "label", "value").agg(
        F.min("rank").alias("rank"), F.sum("count").alias("count"), F.max("omitted_values").alias("omitted_values")
    )


def _distribution(values: Column) -> Column:
    """label -> (value -> count), with an extra entry of 0 naming how many values were left out."""
    names = F.array_distinct(F.transform(values, lambda v: v["label"]))

    def of(name: Column) -> Column:
        own = F.filter(values, lambda v: v["label"] == name)
        left_out = F.get(F.transform(own, lambda v: v["omitted_values"]), 0)
        listed = F.transform(own, lambda v: F.struct(v["value"].alias("key"), v["count"].alias("value")))
        mark = F.struct(F.concat(F.lit("(+"), left_out.cast("string"), F.lit(" more values)")).alias("key"), F.lit(0).cast("bigint").alias("value"))
        return F.map_from_entries(F.when(left_out > 0, F.array_append(listed, mark)).otherwise(listed))

    entries = F.transform(names, lambda n: F.struct(n.alias("key"), of(n).alias("value")))
    return F.when(F.size(names) > 0, F.map_from_entries(entries))


def stats_parts(
    points: DataFrame,
    keys: Sequence[str],
    scope: Sequence[str] = (),
    *,
    step: str | Column,
    labels: Column | None = None,
    cap: int = MAX_SERIES,
    rescue: int = MAX_RESCUED,
    listed: int = MAX_LISTED,
    with_points: int = MAX_WITH_POINTS,
    points_shown: int = MAX_POINTS,
    redact: bool = True,
) -> DataFrame:
    """What a statistics report is made of, one row per scope: counts of what is left out and the reported series.

    ``labels`` is the label map of a series over ``keys``; without it the keys themselves are the labels.
    """
    all_keys = [*scope, *keys]
    display = column_key(list(keys)) if labels is None else series_key(labels)
    summaries = trend_summary(points, all_keys, step=step, evidence=points_shown).withColumn("series", display)
    ranked = rank_series(summaries, scope, keys, cap=cap, rescue=rescue, listed=listed)
    if redact:
        ranked = redact_columns(ranked, "series")

    fields = ["total", "avg", "avg_per_minute", "latest", "peak", "peak_time", "trend", "non_zero_pct", "anomaly"]
    form = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    summary = F.struct(*[F.date_format(f, form).alias(f) if f == "peak_time" else F.col(f) for f in fields])
    if labels is None:
        pairs = [x for k in keys for x in (F.lit(k), F.col(k).cast("string"))]
        labels = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")
    ranked = ranked.withColumn("__labels", labels)
    if redact:
        ranked = ranked.withColumn("__labels", F.when(F.col("kept"), redact_values("__labels")))
    shown = F.transform(
        "points", lambda p: F.struct(F.date_format(p["ts"], form).alias("timestamp"), p["value"].cast("string").alias("value"))
    )
    values = F.when(F.col("report_rank") <= with_points, shown)
    entry = F.struct(
        F.col("report_rank").alias("place"),
        F.struct(F.col("series").alias("key"), summary.alias("value")).alias("summary"),
        F.struct(F.col("__labels").alias("labels"), values.alias("values")).alias("series"),
    )
    kept = F.array_sort(F.collect_list(F.when(F.col("kept"), entry)), _by_place)
    return ranked.groupBy(*scope).agg(*omitted_columns("series", listed=listed), kept.alias("__kept"))


def stats_json(one: DataFrame, scope: Sequence[str], *, step: Column, codes: Column, budget: int | None = None) -> DataFrame:
    """The reports of ``stats_parts`` rows that also carry what was asked (``__query``, ``__range``); codes come first."""
    some_left, some_odd = F.col("omitted_series") > 0, F.col("omitted_anomalous") > 0
    head = [
        F.col("total_series"),
        F.when(some_left, F.col("omitted_series")).alias("omitted_series"),
        F.when(some_left, F.col("omitted_keys")).alias("omitted_series_keys"),
        F.when(some_odd, F.col("omitted_anomalous")).alias("omitted_anomaly_series"),
        F.when(some_odd, F.col("omitted_anomalous_keys")).alias("omitted_anomaly_series_keys"),
        step.alias("step"),
        F.col("__query").alias("query_executed"),
        F.col("__range").alias("time_range"),
    ]
    own = F.array(F.when(some_left, "series_capped"), F.when(some_odd, "anomalous_series_omitted"))
    noted = F.concat(codes, F.array_compact(own))
    cut_noted = F.concat(noted, F.array(F.lit("size_budget_points_dropped"))).alias("warnings")
    by_key = F.map_from_entries(_last_by_key(F.transform("__kept", lambda e: e["summary"]))).alias("summaries")
    series = F.transform("__kept", lambda e: e["series"]).alias("series")
    full, cut = F.struct(*head, noted.alias("warnings"), by_key, series), F.struct(*head, cut_noted, by_key)
    out = bounded_json(one, full, cut, name="stats_report", budget=budget)
    return out.select(*scope, "total_series", "omitted_series", "omitted_anomalous", "size_bytes", "form", "report")


def stats_report(
    points: DataFrame,
    keys: Sequence[str],
    scope: Sequence[str] = (),
    *,
    step: str,
    query: str = "",
    time_range: str = "",
    cap: int = MAX_SERIES,
    rescue: int = MAX_RESCUED,
    listed: int = MAX_LISTED,
    with_points: int = MAX_WITH_POINTS,
    points_shown: int = MAX_POINTS,
    redact: bool = True,
    budget: int | None = None,
) -> DataFrame:
    """Trend summaries of the reported series, points of the first few, and counts of what was left out.

    ``points`` is a dense grid (``idx`` and ``n_points``); ``keys`` tell series apart inside a scope.
    """
    caps = {"cap": cap, "rescue": rescue, "listed": listed, "with_points": with_points, "points_shown": points_shown}
    one = _asked(stats_parts(points, keys, scope, step=step, redact=redact, **caps), query, time_range, redact)
    codes = F.array_compact(F.array(F.when(F.col("total_series") == 0, "no_rows")))
    return stats_json(one, scope, step=F.lit(step), codes=codes, budget=budget)


def _last_by_key(entries: Column) -> Column:
    """Equal display keys (redaction can make them equal) keep the last entry."""
    keys = F.transform(entries, lambda e: e["key"])
    return F.filter(entries, lambda e, i: ~F.exists(F.slice(keys, i + 2, F.size(keys)), lambda k: k == e["key"]))


def label_values_report(
    logs: DataFrame,
    name: str,
    scope: Sequence[str] = (),
    *,
    contains: str | None = None,
    limit: int | None = DEFAULT_VALUES,
    redact: bool = True,
    budget: int | None = None,
) -> DataFrame:
    """Values of one label per scope, with totals, the truncation flag and warning codes."""
    n = check_limit(limit)
    values = ranked_values(logs, name, scope, contains, n)
    if redact:
        values = redact_columns(values, "value")
    found = F.sort_array(F.collect_list(F.when(F.col("hit"), F.struct("rank", "value"))))
    one = values.groupBy(*scope).agg(
        F.coalesce(F.max("total_values"), F.lit(0)).alias("total_values"),
        F.coalesce(F.max("total_label_values"), F.lit(0)).alias("total_label_values"),
        F.transform(found, lambda x: x["value"]).alias("values"),
    )
    truncated = F.lit(False) if n is None else F.col("total_values") > n
    no_match = (F.col("total_values") == 0) & (F.col("total_label_values") > 0)

    def shape(values_col: Column, cut: Column, extra: list[Column]) -> Column:
        codes = [F.when(no_match, "no_value_contains"), F.when(truncated, "values_capped"), *extra]
        return F.struct(
            F.lit(name).alias("label_name"),
            F.col("total_values"),
            (F.col("total_label_values") if contains else F.lit(None).cast("bigint")).alias("total_label_values"),
            cut.alias("truncated"),
            F.array_compact(F.array(*codes)).alias("warnings"),
            values_col.alias("values"),
        )

    full = shape(F.col("values"), truncated, [])
    many = F.size("values") > SHRUNK_VALUES
    cut = shape(F.slice("values", 1, SHRUNK_VALUES), truncated | many, [F.when(many, "size_budget_values_cut")])
    out = bounded_json(one, full, cut, name="label_values_report", budget=budget)
    return out.select(*scope, "total_values", "total_label_values", truncated.alias("truncated"), "size_bytes", "form", "report")


def write_reports(reports: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON document per line."""
    reports.select(F.col("report").alias("value")).write.mode(mode).text(path)
