"""Counts over time, rates, sums, dense grids, top-k series, down-sampling.

Series points are rows ``keys..., ts TIMESTAMP_NTZ, value``. A point at ``t``
covers the range ``(t - range, t]``.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logfathom.functions.clock import MICROS, ceil_to, floor_div, from_micros, ntz, span_micros, to_micros
from logfathom.operators.topk import first_k

Span = str | int | float
Moment = str | datetime

# Fixed value: raw points kept per series.
MAX_POINTS = 24

_HOUR_US = 3600 * MICROS


def label_columns(logs: DataFrame, names: Sequence[str]) -> list[Column]:
    """Key columns: a flat column when the table has one of that name, else the label."""
    return [F.col(n) if n in logs.columns else F.col("labels")[n].alias(n) for n in names]


def count_over_time(
    logs: DataFrame,
    keys: Sequence[str],
    step: Span,
    *,
    range_: Span | None = None,
    start: Moment | None = None,
    end: Moment | None = None,
) -> DataFrame:
    """Rows per series in the look-back range at each multiple of ``step``, points at t with start < t <= end.

    Rows are first counted into slots of gcd(step, range); only those counts are
    spread over the overlapping ranges, so a long range costs no more shuffled rows.
    """
    step_us = span_micros(step)
    range_us = span_micros(range_) if range_ is not None else step_us
    slot = gcd(step_us, range_us)
    if start is not None:
        logs = logs.where(F.col("ts") > ntz(start) - F.expr(f"INTERVAL '{range_us / MICROS:.6f}' SECOND"))
    if end is not None:
        logs = logs.where(F.col("ts") <= ntz(end))
    slotted = logs.select(*label_columns(logs, keys), ceil_to(to_micros(F.col("ts")), slot).alias("__at"))
    counts = slotted.groupBy(*keys, "__at").agg(F.count("*").alias("value"))
    if range_us != step_us:
        first = ceil_to(F.col("__at"), step_us)
        last = F.col("__at") + (range_us - slot)
        spread = counts.where(first <= last).withColumn("__at", F.explode(F.sequence(first, last, F.lit(step_us))))
        counts = spread.groupBy(*keys, "__at").agg(F.sum("value").alias("value"))
    points = counts.select(*keys, from_micros(F.col("__at")).alias("ts"), "value")
    if start is not None:
        points = points.where(F.col("ts") > ntz(start))
    if end is not None:
        points = points.where(F.col("ts") <= ntz(end))
    return points


def rate(points: DataFrame, range_: Span) -> DataFrame:
    """Counts per second of the look-back range."""
    return points.withColumn("value", F.col("value") / F.lit(span_micros(range_) / MICROS))


def sum_by(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sum of all series per remaining key and time; no keys gives one overall series."""
    return points.groupBy(*keys, "ts").agg(F.sum("value").alias("value"))


def instant_counts(logs: DataFrame, keys: Sequence[str], at: Moment, range_: Span) -> DataFrame:
    """The count of each series at one instant."""
    back = F.expr(f"INTERVAL '{span_micros(range_) / MICROS:.6f}' SECOND")
    inside = logs.where((F.col("ts") > ntz(at) - back) & (F.col("ts") <= ntz(at)))
    counted = inside.select(*label_columns(logs, keys)).groupBy(*keys).agg(F.count("*").alias("value"))
    return counted.select(*keys, ntz(at).alias("ts"), "value")


def dense_grid(
    points: DataFrame, keys: Sequence[str], step: Span | Column, start: Moment | Column, end: Moment | Column, *, series: DataFrame | None = None
) -> DataFrame:
    """Zero-fill every multiple of ``step`` with start < t <= end, adding ``idx`` and ``n_points``.

    Gaps are filled between neighbouring points, so no series list is built and
    joined. ``series`` adds known series that may have no points at all. A series
    holds at most (end - start) / step rows here, whatever its volume was. Step (in
    microseconds) and bounds may be columns over ``keys``, so that series have grids of their own.
    """
    step_us = step if isinstance(step, Column) else span_micros(step)
    lo = ceil_to(to_micros(ntz(start)) + 1, step_us)
    hi = floor_div(to_micros(ntz(end)), step_us) * step_us
    at = points.select(*keys, to_micros(F.col("ts")).alias("__at"), "value")
    if series is not None:
        known = series.select(*keys).withColumn("__at", lo).withColumn("value", F.lit(0).cast(points.schema["value"].dataType))
        at = at.unionByName(known).groupBy(*keys, "__at").agg(F.sum("value").alias("value"))
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    near = own.orderBy("__at")
    prior, later = F.lag("__at").over(near), F.lead("__at").over(near)
    zero = F.lit(0).cast(points.schema["value"].dataType)
    gapped = at.where((F.col("__at") >= lo) & (F.col("__at") <= hi))
    gapped = gapped.select(*keys, "__at", "value", prior.alias("__prior"), later.alias("__later"))

    own_point = F.array(F.struct(F.col("__at").alias("at"), F.col("value")))
    stop = F.coalesce(F.col("__later") - step_us, hi)
    after = _zeros(F.col("__at") + step_us, stop, step_us, zero)
    before = F.when(F.col("__prior").isNull(), _zeros(lo, F.col("__at") - step_us, step_us, zero))
    filled = gapped.select(*keys, F.inline(F.concat(F.coalesce(before, F.slice(own_point, 1, 0)), own_point, after)))
    index = F.call_function("div", F.col("at") - lo, F.lit(step_us))
    size = F.call_function("div", hi - lo, F.lit(step_us)) + 1
    return filled.select(*keys, from_micros(F.col("at")).alias("ts"), "value", index.alias("idx"), size.alias("n_points"))


def _zeros(first: Column, last: Column, step_us: int, zero: Column) -> Column:
    times = F.when(first <= last, F.sequence(first, last, F.lit(step_us))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(times, lambda t: F.struct(t.alias("at"), zero.alias("value")))


def point_index(points: DataFrame, keys: Sequence[str], *, tie: str | None = None) -> DataFrame:
    """Add ``idx`` (0-based place by time) and ``n_points`` to series of any length.

    Places are counted per hour and shifted by the running total of earlier hours,
    so a long series is ranked in hourly pieces and never sorted in one task. The
    counts are joined on the same key the pieces are ranked by: one shuffle serves both.
    """
    order = [F.col("ts")] + ([F.col(tie)] if tie else [])
    series = F.struct(*keys) if keys else F.lit(0)
    pieces = points.withColumns({"__series": series, "__hour": floor_div(to_micros(F.col("ts")), _HOUR_US)})
    counts = pieces.groupBy("__series", "__hour").agg(F.count("*").alias("__n"))
    own = Window.partitionBy("__series")
    earlier = F.sum("__n").over(own.orderBy("__hour").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select(
        "__series", "__hour", F.coalesce(earlier, F.lit(0)).alias("__shift"), F.sum("__n").over(own).alias("n_points")
    )
    inside = F.row_number().over(Window.partitionBy("__series", "__hour").orderBy(*order)) - 1
    placed = pieces.join(shifts, ["__series", "__hour"]).withColumn("idx", inside + F.col("__shift"))
    return placed.select(*points.columns, "idx", "n_points")


def is_kept_point(idx: Column, n: Column, max_points: int = MAX_POINTS) -> Column:
    """Whether a point survives down-sampling: the first, the last, and evenly spread ones between."""
    stride = (n - 1) / F.lit(float(max_points - 1))
    guess = F.round(idx / stride)
    near = F.array(guess - 1, guess, guess + 1)
    chosen = F.exists(near, lambda i: i.between(0, max_points - 1) & (F.round(i * stride) == idx))
    return (n <= max_points) | chosen


def downsample(points: DataFrame, max_points: int = MAX_POINTS) -> DataFrame:
    """Cut longer series to ``max_points``. Needs ``idx`` and ``n_points``.

    A row decides from its own place whether it is kept: no join, no window.
    """
    return points.where(is_kept_point(F.col("idx"), F.col("n_points"), max_points))


def topk_series(points: DataFrame, k: int, scope: Sequence[str] = (), *, keys: Sequence[str]) -> DataFrame:
    """The k largest series at each time; equal values go by key."""
    order = [F.col("value").desc(), *[F.col(c).asc() for c in keys]]
    return first_k(points, [*scope, "ts"], order, k)
