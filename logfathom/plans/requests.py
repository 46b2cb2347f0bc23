"""Reports for a table of requests: one request in, one report out, with all that was repaired or widened said inside.

A request is a row of ``request_id``, ``as_of``, ``start_expr``, ``end_expr`` and its selection as data: ``matchers``
(array of name, op, value), ``contains``, ``excludes``, ``regex``, ``not_regex`` (arrays of text). Logs requests may carry
``limit`` and ``direction``, statistics requests ``group_by`` (label names) and ``step``, label requests ``label``,
``contains_text`` and ``limit``. Missing columns and nulls mean the default.

Requests with the same selection share it: rows are matched with selections, not with requests, and the merge that finds
the newest row before each end serves all of them. Rows meet requests only inside the windows that are finally used.
The matched rows, the windows and their pairs are written between steps (``session.written``): the log is read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logfathom.functions.clock import MICROS, ceil_to, floor_div, from_micros, to_micros
from logfathom.functions.redaction import redact_columns
from logfathom.functions.timeexpr import duration_nanos
from logfathom.operators.labels import INTERNAL_PREFIX, ranked_values
from logfathom.operators.select import DEFAULT_LABEL, DEFAULT_LIMIT
from logfathom.operators.series import dense_grid
from logfathom.operators.windows import (
    LABEL_HOURS, QUERY_HOURS, WIDEN_HOURS, auto_widen, dyadic_pieces, in_cells, in_levels, levels_of, pruned, repair_window, resolve_window, result_warning, rows_in_windows, with_step,
)
from logfathom.plans.reports import _asked, logs_json, logs_parts, stats_json, stats_parts
from logfathom.session import written

MATCHERS = "array<struct<name: string, op: string, value: string>>"
TEXTS = ("contains", "excludes", "regex", "not_regex")
HOUR = 3600 * MICROS


def with_columns(requests: DataFrame, **kinds: str) -> DataFrame:
    """The requests with those columns in those types; missing ones are null."""
    have = set(requests.columns)
    return requests.withColumns({c: (F.col(c) if c in have else F.lit(None)).cast(kind) for c, kind in kinds.items()})


def with_selection(requests: DataFrame, default_label: str = DEFAULT_LABEL) -> DataFrame:
    """Adds ``selection``, the matchers and filters as one struct. No matchers means every row with ``default_label``."""
    shaped = with_columns(requests, matchers=MATCHERS, **dict.fromkeys(TEXTS, "array<string>"))
    default = F.array(F.struct(F.lit(default_label).alias("name"), F.lit("!=").alias("op"), F.lit("").alias("value"))).cast(MATCHERS)
    asked = F.when(F.size(F.coalesce("matchers", F.array().cast(MATCHERS))) > 0, F.col("matchers")).otherwise(default)
    lists = [F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in TEXTS]
    return shaped.withColumn("selection", F.struct(asked.alias("matchers"), *lists)).drop("matchers", *TEXTS)


def matches(selection: Column, labels: Column, line: Column) -> Column:
    """Whether a row is in a selection that is itself data; ops and regexes as in ``match_label`` and ``line_filter``."""

    def one(m: Column) -> Column:
        found = F.coalesce(F.try_element_at(labels, m["name"]), F.lit(""))
        hit = F.rlike(found, F.concat(F.lit(r"\A(?:"), m["value"], F.lit(r")\z")))
        tests = F.when(m["op"] == "=", found == m["value"]).when(m["op"] == "!=", found != m["value"])
        return tests.when(m["op"] == "=~", hit).when(m["op"] == "!~", ~hit).otherwise(F.raise_error(F.lit("unknown matcher")).cast("boolean"))

    return (
        F.forall(selection["matchers"], one)
        & F.forall(selection["contains"], lambda t: F.contains(line, t))
        & ~F.exists(selection["excludes"], lambda t: F.contains(line, t))
        & F.forall(selection["regex"], lambda t: F.rlike(line, t))
        & ~F.exists(selection["not_regex"], lambda t: F.rlike(line, t))
    )


def match_selections(logs: DataFrame, requests: DataFrame) -> DataFrame:
    """Every (row, selection) match, once however many requests share the selection.

    A selection with an equality matcher is looked up by that label and value; rows are spread over their labels of such
    names only. Selections without one are few texts, carried as one array and tested where the row is.
    """
    distinct = requests.select("selection").distinct()
    exact = F.filter("selection.matchers", lambda m: (m["op"] == "=") & (m["value"] != ""))
    split = distinct.withColumn("__key", F.get(exact, 0))
    keyed = split.where("__key IS NOT NULL").select("selection", F.col("__key.name").alias("__name"), F.col("__key.value").alias("__value"))

    names = keyed.agg(F.collect_set("__name")).scalar()
    spread = logs.select(*logs.columns, F.explode("labels").alias("__name", "__value"))
    spread = spread.where(F.array_contains(names, F.col("__name")) & F.col("__value").isNotNull())
    found = spread.join(keyed, ["__name", "__value"]).drop("__name", "__value")

    loose = split.where("__key IS NULL").agg(F.collect_list("selection")).scalar()
    tested = logs.withColumn("selection", F.explode(loose))
    both = found.unionByName(tested)
    return both.where(matches(F.col("selection"), F.col("labels"), F.col("line")))


def resolved(requests: DataFrame, *, hours_back: int, max_hours: int | None, repair: bool = True) -> DataFrame:
    """Requests with start_ts, end_ts, start_given and warnings. A time that can't be read leaves no window and a code."""
    asked = resolve_window(with_columns(requests, start_expr="string", end_expr="string"), hours_back=hours_back)
    if repair:
        asked = repair_window(asked, max_hours=max_hours)
    else:
        asked = asked.withColumn("warnings", F.array().cast("array<string>"))
    unread = F.col("start_ts").isNull() | F.col("end_ts").isNull()
    codes = F.when(unread, F.array(F.lit("bad_time"))).otherwise(F.col("warnings"))
    keep = lambda c: F.when(~unread, F.col(c)).alias(c)
    return asked.withColumn("warnings", codes).select(*[c for c in asked.columns if c not in ("start_ts", "end_ts", "warnings")], keep("start_ts"), keep("end_ts"), "warnings")


def answered(matched: DataFrame, asked: DataFrame, max_hours: int | None) -> DataFrame:
    """Requests with ``used_start`` and all codes, the widening's last. The selection is compared as its JSON text."""
    widened = auto_widen(matched.select("__selection", "ts"), asked, ["__selection"], max_hours=max_hours)
    noted = result_warning(widened)
    code = F.when(F.col("start_ts").isNotNull(), F.col("warning"))
    return noted.withColumn("warnings", F.array_compact(F.array_append("warnings", code))).drop("warning")


def time_range(start: Column, end: Column) -> Column:
    form = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    return F.concat_ws(" to ", F.date_format(start, form), F.date_format(end, form))


def _prepared(logs: DataFrame, requests: DataFrame, default_label: str, max_hours: int | None) -> tuple[DataFrame, DataFrame]:
    asked = with_selection(resolved(requests, hours_back=QUERY_HOURS, max_hours=max_hours), default_label)
    asked = written(asked.withColumn("__selection", F.to_json("selection")))
    span = F.least("start_ts", from_micros(to_micros(F.col("end_ts")) - max([h for h in WIDEN_HOURS if max_hours is None or h <= max_hours], default=0) * HOUR))
    near = pruned(logs, asked, span, F.col("end_ts"))
    matched = match_selections(near, asked).withColumn("__selection", F.to_json("selection")).drop("selection")
    matched = written(matched)
    return matched, written(answered(matched, asked, max_hours))


def logs_reports(
    logs: DataFrame, requests: DataFrame, *, default_label: str = DEFAULT_LABEL, default_limit: int | None = DEFAULT_LIMIT,
    max_hours: int | None = None, redact: bool = True, budget: int | None = None, **shown: int,
) -> DataFrame:
    """One logs report per request: request_id, matched, used_start, end_ts, warnings, report."""
    requests = with_columns(requests, limit="int", direction="string")
    matched, used = _prepared(logs, requests, default_label, max_hours)
    spans = used.select("request_id", "__selection", "direction", F.col("used_start").alias("start_ts"), "end_ts")
    inside = written(rows_in_windows(matched, spans, ["__selection"]).drop("__selection", "start_ts", "end_ts"))
    min_rows = {"min_rows": shown.pop("min_rows")} if "min_rows" in shown else {}
    parts = logs_parts(inside, ["request_id"], direction=F.col("direction"), redact=redact, **shown)
    head = used.select("request_id", "selection", "limit", "direction", "used_start", "end_ts", "warnings")
    one = head.join(parts, "request_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("matched", "total_patterns")})
    one = _asked(one, F.to_json("selection"), time_range(F.col("used_start"), F.col("end_ts")), redact)
    limit = F.when(F.col("limit") > 0, F.col("limit")).otherwise(F.lit(default_limit).cast("int"))
    way = F.when(F.col("direction") == "forward", "forward").otherwise("backward")
    kept = ["request_id", "used_start", "end_ts", "warnings"]
    return logs_json(one, kept, limit=limit, direction=way, codes=F.col("warnings"), budget=budget, **min_rows)


def stats_reports(
    logs: DataFrame, requests: DataFrame, *, default_label: str = DEFAULT_LABEL, max_hours: int | None = None,
    redact: bool = True, budget: int | None = None, **caps: int,
) -> DataFrame:
    """One statistics report per request over counts per step and ``group_by`` labels, zero-filled.

    The step is the request's, or picked again for the window finally used; one that is no duration gives a code and the
    picked one. Points lie at multiples of the step inside the window and look back one step.
    """
    requests = with_columns(requests, group_by="array<string>", step="string")
    matched, used = _prepared(logs, requests, default_label, max_hours)
    given = F.coalesce(F.col("step"), F.lit("")) != ""
    bad = given & ~F.coalesce(duration_nanos(F.col("step")) >= 1000, F.lit(False))
    used = used.withColumn("warnings", F.when(bad, F.array_append("warnings", F.lit("bad_step"))).otherwise(F.col("warnings")))
    spans = used.withColumn("step", F.when(bad, F.lit("")).otherwise(F.col("step")))
    spans = with_step(spans.drop("start_ts").withColumnRenamed("used_start", "start_ts"))
    spans = spans.withColumn("__step", F.call_function("div", duration_nanos(F.col("step")), F.lit(1000)))
    first = ceil_to(to_micros(F.col("start_ts")) + 1, F.col("__step"))
    last = floor_div(to_micros(F.col("end_ts")), F.col("__step")) * F.col("__step")
    spans = written(spans.withColumns({"__from": F.col("start_ts"), "__to": F.col("end_ts")}))
    look = spans.withColumns({"start_ts": from_micros(first - F.col("__step") + 1), "end_ts": from_micros(last + 1)})

    own = ["request_id", "step", "__step", "__from", "__to"]
    inside = rows_in_windows(matched.select("__selection", "ts", "labels"), look.select(*own, "group_by", "__selection", "start_ts", "end_ts"), ["__selection"])
    named = F.filter(F.map_entries("labels"), lambda e: F.array_contains(F.col("group_by"), e["key"]) & e["value"].isNotNull())
    series = F.to_json(F.map_from_entries(F.array_sort(named)))
    slotted = inside.select(*own, F.coalesce(series, F.lit("{}")).alias("series_json"), ceil_to(to_micros(F.col("ts")), F.col("__step")).alias("__at"))
    keys = [*own, "series_json"]
    points = slotted.groupBy(*keys, "__at").agg(F.count("*").alias("value")).select(*keys, from_micros(F.col("__at")).alias("ts"), "value")
    dense = dense_grid(points, keys, F.col("__step"), F.col("__from"), F.col("__to"))
    labels = F.from_json("series_json", "map<string,string>")
    parts = stats_parts(dense, ["series_json"], own, step=F.col("step"), labels=labels, redact=redact, **caps)

    head = spans.select("request_id", "selection", "step", F.col("start_ts").alias("used_start"), "end_ts", "warnings")
    one = head.join(parts.drop("step", "__step", "__from", "__to"), "request_id", "left")
    one = one.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total_series", "omitted_series", "omitted_anomalous")})
    one = one.withColumn("__kept", F.coalesce("__kept", F.array().cast(parts.schema["__kept"].dataType)))
    one = _asked(one, F.to_json("selection"), time_range(F.col("used_start"), F.col("end_ts")), redact)
    kept = ["request_id", "used_start", "end_ts", "step", "warnings"]
    return stats_json(one, kept, step=F.col("step"), codes=F.col("warnings"), budget=budget)


def label_names_reports(logs: DataFrame, requests: DataFrame, *, internal: bool = False) -> DataFrame:
    """Label names inside each request's window, six hours by default: request_id, names, warnings.

    Rows are reduced to the names of each cell between two windows' ends, and windows meet runs of cells: no row meets a window.
    """
    asked = written(resolved(requests, hours_back=LABEL_HOURS, max_hours=None, repair=False))
    names = F.map_keys(F.map_filter("labels", lambda k, v: v.isNotNull()))
    near = pruned(logs, asked, F.col("start_ts"), F.col("end_ts"))
    cells, placed = in_cells(near.select("ts", F.sort_array(names).alias("names")), asked.select("start_ts", "end_ts").distinct())
    held = cells.select("names", "__cell").distinct().select("__cell", F.explode("names").alias("name")).distinct()
    if not internal:
        held = held.where(~F.col("name").startswith(INTERNAL_PREFIX))
    met = dyadic_pieces(placed, "__first", "__end").join(in_levels(held, levels_of(placed)).distinct(), ["__level", "__id"])
    inside = met.groupBy("start_ts", "end_ts").agg(F.collect_set("name").alias("names"))
    found = asked.select("request_id", "start_ts", "end_ts").join(inside, ["start_ts", "end_ts"])
    listed = found.groupBy("request_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))).alias("names"))
    one = asked.select("request_id", "warnings").join(listed, "request_id", "left")
    return one.withColumn("names", F.coalesce("names", F.array().cast("array<string>")))


def _totals_in_spans(held: DataFrame, spans: DataFrame, levels: Column) -> DataFrame:
    """Distinct values of (label, text) in each span of cells: ``held`` has them by cell, with ``__before``, the last cell
    that had the same value.

    A value is counted in the first cell of the span that has it, the one whose ``__before`` lies ahead of the span. A span
    is cut into runs, and a run's cells are sums by ``__before`` that are merged with the spans' first cells.
    """
    own = ["label", "text", "__first", "__end"]
    runs = ["label", "text", "__level", "__id"]
    cut = dyadic_pieces(spans, "__first", "__end")
    firsts = held.groupBy("label", "text", "__cell", "__before").agg(F.count("*").alias("__n"))
    points = in_levels(firsts, levels).join(cut.select(*runs).distinct(), runs, "left_semi")
    points = points.groupBy(*runs, F.col("__before").alias("__at")).agg(F.sum("__n").alias("__n"))
    blank = [F.lit(None).cast("bigint").alias(c) for c in ("__first", "__end")]
    marks = cut.select(*runs, F.col("__first").alias("__at"), F.lit(0).cast("bigint").alias("__n"), "__first", "__end")
    both = points.select(*runs, "__at", "__n", *blank).unionByName(marks)
    so_far = Window.partitionBy(*runs).orderBy("__at", F.col("__first").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = both.withColumn("__n", F.sum("__n").over(so_far)).where("__first IS NOT NULL")
    return counted.groupBy(*own).agg(F.sum("__n").alias("total"))


def _listed_in_spans(held: DataFrame, spans: DataFrame, levels: Column, most: int | None, redact: bool) -> DataFrame:
    """The first ``most`` values of (label, text) in each span of cells, in text order: the first of the runs' first ones."""
    own, runs = ["label", "text", "__first", "__end"], ["label", "text", "__level", "__id"]

    def first(df: DataFrame, keys: list[str]) -> DataFrame:
        ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("value")))
        return ranked if most is None else ranked.where(F.col("rank") <= most)

    cut = dyadic_pieces(spans, "__first", "__end")
    asked = in_levels(held.select("label", "text", "value", "__cell"), levels).distinct().join(cut.select(*runs).distinct(), runs, "left_semi")
    met = cut.join(first(asked, runs).drop("rank"), runs).select(*own, "value").distinct()
    ranked = first(met, own)
    if redact:
        ranked = redact_columns(ranked, "value")
    values = F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda e: e["value"])
    return ranked.groupBy(*own).agg(values.alias("values"))


def _values_in_windows(logs: DataFrame, spans: DataFrame, redact: bool) -> DataFrame:
    """Spans (label, contains_text, start_ts, end_ts and others; without ``most`` all are listed) with total_values,
    total_label_values and the first values; those that hold no value are left out.

    Values are reduced to one a cell between two spans' ends, and spans meet runs of cells, so that equal spans share all
    work and none meets a row or, unless it lists them, all values.
    """
    asked = spans.withColumn("text", F.lower(F.coalesce("contains_text", F.lit(""))))
    near = pruned(logs, asked, F.col("start_ts"), F.col("end_ts"))
    pairs = near.select("ts", F.explode("labels").alias("label", "value")).where("value IS NOT NULL").join(asked.select("label").distinct(), "label", "left_semi")
    cells, placed = in_cells(pairs, asked.select("start_ts", "end_ts").distinct())
    seen = written(cells.select("label", "value", "__cell").distinct())
    asked = written(asked.join(placed, ["start_ts", "end_ts"]))
    unlimited = F.lit(1 << 31)
    most = asked.agg(F.max(F.coalesce("most", unlimited))).first()[0]
    levels = levels_of(asked)

    own = ["label", "text", "__first", "__end"]
    wanted = asked.select(*own).distinct()
    counted = asked.select("label", F.explode(F.array_distinct(F.array("text", F.lit("")))).alias("text"), "__first", "__end").distinct()
    texts = counted.select("label", "text").distinct()
    hits = seen.select("label", "value").distinct().join(texts, "label").where(F.contains(F.lower("value"), F.col("text")))
    before = F.lag("__cell", 1, 0).over(Window.partitionBy("label", "value").orderBy("__cell"))
    held = seen.withColumn("__before", before).join(hits, ["label", "value"])

    totals = written(_totals_in_spans(held, counted, levels))
    lists = _listed_in_spans(held, wanted, levels, most if most is not None and most < 1 << 31 else None, redact)
    out = asked.join(totals.withColumnRenamed("total", "total_values"), own, "left")
    out = out.join(totals.where("text = '' AND total > 0").select("label", "__first", "__end", F.col("total").alias("total_label_values")), ["label", "__first", "__end"])
    out = out.join(lists, own, "left")
    values = F.when(F.col("most").isNull(), F.col("values")).otherwise(F.slice("values", F.lit(1), F.coalesce("most", F.lit(1))))
    return out.select(*spans.columns, "total_values", "total_label_values", values.alias("values"))


def _values_of_pairs(logs: DataFrame, spans: DataFrame, own: list[str], redact: bool) -> DataFrame:
    """The same for requests of several spans, whose values are united row by row."""
    near = pruned(logs, spans, F.col("start_ts"), F.col("end_ts"))
    pairs = near.select("ts", F.explode("labels").alias("label", "value")).where("value IS NOT NULL")
    inside = rows_in_windows(pairs, spans, ["label"]).select(*own, "most", F.create_map(F.lit("v"), F.col("value")).alias("labels"))
    ranked = ranked_values(inside, "v", [*own, "most"], F.coalesce("contains_text", F.lit("")), None)
    if redact:
        ranked = redact_columns(ranked, "value")
    shown = F.col("hit") & F.coalesce(F.col("rank") <= F.col("most"), F.lit(True))
    listed = F.transform(F.sort_array(F.collect_list(F.when(shown, F.struct("rank", "value")))), lambda e: e["value"])
    return ranked.groupBy(*own).agg(F.max("total_values").alias("total_values"), F.max("total_label_values").alias("total_label_values"), listed.alias("values"))


def label_values_reports(logs: DataFrame, requests: DataFrame, *, default_limit: int | None = None, redact: bool = True) -> DataFrame:
    """Values of each request's ``label`` inside its window, those with ``contains_text`` in them, cut to its ``limit``.

    Gives request_id, total_values, total_label_values, truncated, values, warnings. Requests of one id, text and limit are
    one answer over the values of all their windows.
    """
    asked = resolved(with_columns(requests, label="string", contains_text="string", limit="int"), hours_back=LABEL_HOURS, max_hours=None, repair=False)
    unnamed = F.coalesce(F.col("label"), F.lit("")) == ""
    asked = written(asked.withColumn("warnings", F.when(unnamed, F.array_append("warnings", F.lit("label_required"))).otherwise(F.col("warnings"))))
    limit = F.coalesce(F.when(F.col("limit") > 0, F.col("limit")), F.lit(default_limit).cast("int"))
    own = ["request_id", "contains_text", "limit"]
    spans = asked.where("request_id IS NOT NULL AND label IS NOT NULL AND start_ts < end_ts").withColumn("most", limit)
    spans = spans.select(*own, "most", "label", "start_ts", "end_ts").distinct()
    spans = written(spans.withColumn("__spans", F.count("*").over(Window.partitionBy(*own))))
    single, several = (spans.where(c).drop("__spans") for c in ("__spans = 1", "__spans > 1"))
    parts = _values_in_windows(logs, single, redact).select(*own, "total_values", "total_label_values", "values")
    if not several.isEmpty():
        parts = parts.unionByName(_values_of_pairs(logs, several, own, redact))
    one = asked.select(*own, "warnings").join(parts.drop("contains_text", "limit"), "request_id", "left")
    one = one.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total_values", "total_label_values")})
    one = one.withColumn("values", F.coalesce("values", F.array().cast("array<string>")))
    truncated = F.coalesce(F.col("total_values") > limit, F.lit(False))
    codes = [F.when((F.col("total_values") == 0) & (F.col("total_label_values") > 0), "no_value_contains"), F.when(truncated, "values_capped")]
    noted = F.array_compact(F.concat("warnings", F.array(*codes)))
    return one.select("request_id", "total_values", "total_label_values", truncated.alias("truncated"), "values", noted.alias("warnings"))
