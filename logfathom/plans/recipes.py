"""Investigations composed from the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logfathom.functions.clock import MICROS, floor_div, from_micros, ntz, span_micros, to_micros
from logfathom.functions.numbers import round_scaled
from logfathom.operators.patterns import top_patterns, with_pattern
from logfathom.operators.ranking import rank_series
from logfathom.operators.select import line_filter, select_logs, time_order
from logfathom.operators.series import Moment, Span, count_over_time, dense_grid, label_columns
from logfathom.operators.trend import trend_summary
from logfathom.operators.windows import rows_in_windows

# Ours: lines that hint at a deployment, at slowness, at a failure. All are defaults of arguments.
DEPLOY_LINES = r"(?i)\b(?:deploy(?:s|ed|ing|ment)?|roll(?:ed|ing)? ?out|rolling[ -]update|(?:re)?started|upgraded?|released?|migrat(?:ed|ion))\b"
SLOW_LINES = r"(?i)\b(?:slow(?:ly)?|timeout|timed out)\b|\b(?:took|elapsed|duration)\W+[0-9]{4,} ?ms\b"
FAILURE_LINES = r"(?i)\b(?:errors?|fail(?:s|ed|ure)?|panic(?:ked)?|exception|timeout)\b"
# Ours: what counts as leaving the baseline, and as an unhealthy service.
ONSET_FACTOR = 1.5
ONSET_HISTORY = 3
CRITICAL_ERROR_SHARE = 0.5
HEALTHY_NON_ZERO_PCT = 25.0


def _seconds(start: Moment, end: Moment) -> Column:
    return (to_micros(ntz(end)) - to_micros(ntz(start))) / F.lit(float(MICROS))


def error_rate(
    logs: DataFrame, matchers, keys: Sequence[str], scope: Sequence[str] = (), *, step: Span, start: Moment, end: Moment, **caps: int
) -> DataFrame:
    """Trend of selected rows per key on a dense grid, ranked as in the statistics report; ``caps`` go to ``rank_series``."""
    every = [*scope, *keys]
    points = count_over_time(select_logs(logs, matchers), every, step, start=start, end=end)
    dense = dense_grid(points, every, step, start, end)
    return rank_series(trend_summary(dense, every, step=str(step)), scope, keys, **caps)


def compare_periods(
    logs: DataFrame, keys: Sequence[str], before: tuple[Moment, Moment], after: tuple[Moment, Moment]
) -> DataFrame:
    """Rows per minute of each series in two periods, the difference, and its place by size of change.

    One pass with two conditional counts: a series missing from one period counts 0 there.
    """
    ts = F.col("ts")

    def inside(period):
        return (ts >= ntz(period[0])) & (ts < ntz(period[1]))

    both = logs.where(inside(before) | inside(after)).select(*label_columns(logs, keys), "ts")
    counted = both.groupBy(*keys).agg(
        F.count(F.when(inside(before), 1)).alias("count_before"), F.count(F.when(inside(after), 1)).alias("count_after")
    )
    per_min = [
        round_scaled(F.col(c) / (_seconds(*p) / 60), 4) for c, p in (("count_before", before), ("count_after", after))
    ]
    rates = counted.withColumn("per_minute_before", per_min[0]).withColumn("per_minute_after", per_min[1])
    delta = round_scaled(F.col("per_minute_after") - F.col("per_minute_before"), 4)
    return rates.withColumn("delta", delta).orderBy(F.abs("delta").desc(), *keys)


def onset(
    dense: DataFrame, keys: Sequence[str], *, factor: float = ONSET_FACTOR, history: int = ONSET_HISTORY, min_value: float | None = None
) -> DataFrame:
    """First point of each series above ``factor`` times the average of all points before it."""
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    past = own.orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    staged = dense.withColumn("__sum", F.sum("value").over(past))
    baseline = F.col("__sum") / F.col("idx")
    left = staged.where((F.col("idx") >= history) & (F.lit(True) if min_value is None else F.col("value") >= min_value) & (F.col("value") > baseline * factor))
    first = left.groupBy(*keys).agg(F.min(F.struct("ts", "value", round_scaled(baseline, 2).alias("baseline"))).alias("f"))
    return first.select(*keys, F.col("f.ts").alias("onset"), F.col("f.value").alias("value"), F.col("f.baseline").alias("baseline"))


def service_health(logs: DataFrame, services: DataFrame, key: str, error: Column, *, start: Moment, end: Moment) -> DataFrame:
    """Volume and errors of every known service side by side; no rows at all means possibly down."""
    inside = logs.where((F.col("ts") > ntz(start)) & (F.col("ts") <= ntz(end)))
    shaped = inside.select(*label_columns(logs, [key]), error.alias("__error"))
    counted = shaped.groupBy(key).agg(F.count("*").alias("rows"), F.count(F.when(F.col("__error"), 1)).alias("errors"))
    joined = services.select(key).distinct().join(counted, key, "left").na.fill(0, ["rows", "errors"])
    return joined.withColumn("status", F.when(F.col("rows") == 0, "possibly_down").otherwise("active"))


def silent_series(logs: DataFrame, keys: Sequence[str], *, start: Moment, since: Moment, end: Moment) -> DataFrame:
    """Series active in [start, since) without a row in [since, end), with their last row's time."""
    ts = F.col("ts")
    inside = logs.where((ts >= ntz(start)) & (ts < ntz(end))).select(*label_columns(logs, keys), "ts")
    counted = inside.groupBy(*keys).agg(
        F.count(F.when(ts < ntz(since), 1)).alias("rows_before"),
        F.count(F.when(ts >= ntz(since), 1)).alias("rows_after"),
        F.max("ts").alias("last_seen"),
    )
    return counted.where((F.col("rows_before") > 0) & (F.col("rows_after") == 0)).drop("rows_after")


def restart_gaps(points: DataFrame, keys: Sequence[str], step: Span) -> DataFrame:
    """Stretches without rows between two active points. Takes sparse points (no row for an empty step)."""
    step_us = span_micros(step)
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    later = F.lead("ts").over(own.orderBy("ts"))
    paired = points.where(F.col("value") > 0).withColumn("resumed_at", later)
    missed = F.call_function("div", to_micros(F.col("resumed_at")) - to_micros(F.col("ts")), F.lit(step_us)) - 1
    gaps = paired.withColumn("empty_steps", missed).where(F.col("empty_steps") > 0)
    return gaps.select(*keys, F.col("ts").alias("last_active"), "resumed_at", "empty_steps")


def blast_radius(logs: DataFrame, who: str, scope: Sequence[str] = (), *, approximate: bool = False) -> DataFrame:
    """Distinct affected identifiers and rows per scope. The approximate form keeps a small sketch per task."""
    ids = logs.select(*scope, *label_columns(logs, [who]))
    distinct = F.approx_count_distinct(who) if approximate else F.count_distinct(who)
    return ids.groupBy(*scope).agg(distinct.alias("affected"), F.count("*").alias("rows"))


def recurrence(logs: DataFrame, scope: Sequence[str] = (), *, gap: Span = "1h") -> DataFrame:
    """Bursts of each message pattern: a burst ends when no such row follows within ``gap``.

    Rows are first reduced to one span per slot of half a gap. Rows inside a slot
    are never further apart than the gap, so bursts found on slots are exact and a
    frequent pattern is ordered by slots, not by rows.
    """
    gap_us = span_micros(gap)
    slot = max(gap_us // 2, 1)
    at = to_micros(F.col("ts"))
    keys = [*scope, "pattern"]
    slots = (
        with_pattern(logs)
        .select(*keys, at.alias("at"), floor_div(at, slot).alias("slot"))
        .groupBy(*keys, "slot")
        .agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count("*").alias("n"))
    )
    own = Window.partitionBy(*keys).orderBy("slot")
    opens = F.coalesce(F.col("lo") - F.lag("hi").over(own) > gap_us, F.lit(True))
    numbered = slots.withColumn("opens", opens).withColumn("burst", F.sum(F.col("opens").cast("int")).over(own))
    bursts = numbered.groupBy(*keys, "burst").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("rows"))
    spaced = bursts.withColumn("since", F.col("lo") - F.lag("lo").over(Window.partitionBy(*keys).orderBy("burst")))
    return spaced.select(
        *keys, "burst", from_micros(F.col("lo")).alias("started"), from_micros(F.col("hi")).alias("ended"), "rows",
        round_scaled(F.col("since") / F.lit(3600.0 * MICROS), 2).alias("hours_since_previous"),
    )


def deploy_lines(logs: DataFrame, pattern: str = DEPLOY_LINES) -> DataFrame:
    return logs.where(line_filter(regex=[pattern]))


def around(moments: DataFrame, rows: DataFrame, *, moment: str = "onset", on: Sequence[str] = (), minutes: int = 30) -> DataFrame:
    """Rows within ``minutes`` of each moment, with the signed distance in seconds."""
    half = minutes * 60 * MICROS
    at = to_micros(F.col(moment))
    windows = moments.withColumn("start_ts", from_micros(at - half)).withColumn("end_ts", from_micros(at + half + 1))
    near = rows_in_windows(rows, windows, on)
    offset = (to_micros(F.col("ts")) - to_micros(F.col(moment))) / F.lit(float(MICROS))
    return near.withColumn("offset_seconds", round_scaled(offset, 2)).drop("start_ts", "end_ts")


def timeline(logs: DataFrame, identifiers: Sequence[str], *, failures: bool = False, failure: str = FAILURE_LINES) -> DataFrame:
    """Rows holding all identifiers, oldest first, across every stream."""
    regex = [failure] if failures else []
    return logs.where(line_filter(contains=identifiers, regex=regex)).orderBy(*time_order("forward"))


def slow_patterns(logs: DataFrame, scope: Sequence[str] = (), *, slow: str = SLOW_LINES, **shown) -> DataFrame:
    """Dominant patterns among rows that mention slowness; ``shown`` goes to ``top_patterns``."""
    return top_patterns(logs.where(line_filter(regex=[slow])), scope, **shown)


def severity(health: DataFrame, trends: DataFrame, key: str) -> DataFrame:
    """critical / warning / healthy from the error trend, the share of errors and how often errors occur."""
    joined = health.join(trends.select(key, "trend", "non_zero_pct"), key, "left")
    share = F.when(F.col("rows") > 0, F.col("errors") / F.col("rows")).otherwise(F.lit(0.0))
    high = share >= CRITICAL_ERROR_SHARE
    rising = F.coalesce(F.col("trend") == "increasing", F.lit(False))
    quiet = F.coalesce(F.col("non_zero_pct"), F.lit(0.0)) <= HEALTHY_NON_ZERO_PCT
    only_errors = (F.col("errors") == F.col("rows")) & (F.col("rows") > 0)
    verdict = (
        F.when(F.col("rows") == 0, "silent")
        .when(only_errors | (rising & high), "critical")
        .when((F.col("errors") == 0) | (quiet & ~rising), "healthy")
        .otherwise("warning")
    )
    return joined.withColumn("error_share", round_scaled(share, 4)).withColumn("verdict", verdict)
