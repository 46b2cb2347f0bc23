"""Trend summary of each series: totals, latest, peak, direction, anomaly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfathom.functions.numbers import exact_sum, finite, round_scaled, strict_double
from logfathom.functions.timeexpr import step_minutes
from logfathom.operators.series import is_kept_point, point_index

# How much the last third must differ from the first.
RISE = 1.3
FALL = 0.7


def trend_direction(valid: Column, total: Column, first: Column, last: Column) -> Column:
    """sparse / stable / increasing / decreasing from the sums of the first and last third."""
    few = F.when(total == 0, "sparse").otherwise("stable")
    silent_start = F.when(last > 0, "increasing").otherwise("stable")
    moved = F.when(last > first * RISE, "increasing").when(last < first * FALL, "decreasing").otherwise("stable")
    judged = F.when((first == 0) & (last == 0), "sparse").when(first == 0, silent_start).otherwise(moved)
    return F.when(valid == 0, "sparse").when(valid < 3, few).otherwise(judged)


def anomaly_class(trend: Column, total: Column, latest: Column) -> Column:
    """rising, went_silent or NULL; takes the rounded numbers."""
    return F.when(trend == "increasing", "rising").when((total > 0) & (latest == 0), "went_silent")


def per_minute(average: Column, step: Column) -> Column:
    """Average per minute from the rounded average; 0 when the step is unknown."""
    minutes = step_minutes(step)
    return F.when(minutes > 0, round_scaled(average / minutes, 2)).otherwise(F.lit(0.0))


def trend_summary(
    points: DataFrame,
    keys: Sequence[str],
    *,
    value: str = "value",
    step: str | Column | None = None,
    series: DataFrame | None = None,
    tie: str | None = None,
    evidence: int | None = None,
) -> DataFrame:
    """One row per series. Text, NaN and infinite values do not count, but keep their place in the thirds.

    Points that carry ``idx`` and ``n_points`` (a dense grid) need no further ranking.
    ``series`` lists keys to report even without points. ``evidence`` adds that
    many down-sampled raw points as the array ``points``, saving a second pass.
    """
    if "idx" not in points.columns or "n_points" not in points.columns:
        points = point_index(points, keys, tie=tie)
    kind = points.schema[value].dataType.simpleString()
    number = strict_double(F.col(value)) if kind == "string" else finite(F.col(value).cast("double"))
    staged = points.withColumn("__v", number)
    v, third = F.col("__v"), F.floor(F.col("n_points") / 3)
    zero = F.lit(0.0)
    kept = is_kept_point(F.col("idx"), F.col("n_points"), evidence) if evidence else F.lit(False)
    point = F.struct(F.col("ts"), F.col(value).alias("value"))
    gathered = [F.sort_array(F.collect_list(F.when(kept, point))).alias("points")] if evidence else []
    raw = staged.groupBy(*keys).agg(
        F.count(v).alias("__valid"),
        F.coalesce(exact_sum(v, kind), zero).alias("__total"),
        F.max(F.when(v.isNotNull(), F.struct(F.col("idx"), v.alias("v"))))["v"].alias("__latest"),
        F.max(F.when(v > 0, F.struct(v.alias("v"), (-F.col("idx")).alias("i"), F.col("ts").alias("ts")))).alias("__top"),
        F.count(F.when(v > 0, 1)).alias("__positive"),
        F.coalesce(exact_sum(F.when(F.col("idx") < third, v), kind), zero).alias("__first"),
        F.coalesce(exact_sum(F.when(F.col("idx") >= F.col("n_points") - third, v), kind), zero).alias("__last"),
        *gathered,
    )
    if series is not None:
        raw = series.select(*keys).join(raw, list(keys), "left")
    valid = F.coalesce(F.col("__valid"), F.lit(0))

    def rounded(x: Column, digits: int = 2) -> Column:
        return F.coalesce(round_scaled(x, digits), zero)

    summary = raw.select(
        *keys,
        *(["points"] if evidence else []),
        rounded(F.col("__total")).alias("total"),
        rounded(F.when(valid > 0, F.col("__total") / valid)).alias("avg"),
        rounded(F.col("__latest")).alias("latest"),
        rounded(F.col("__top")["v"]).alias("peak"),
        F.col("__top")["ts"].alias("peak_time"),
        trend_direction(valid, F.col("__total"), F.col("__first"), F.col("__last")).alias("trend"),
        rounded(F.when(valid > 0, F.col("__positive") / valid * 100), 1).alias("non_zero_pct"),
    )
    step_text = step if isinstance(step, Column) else F.lit(step).cast("string")
    return summary.withColumn("avg_per_minute", per_minute(F.col("avg"), step_text)).withColumn(
        "anomaly", anomaly_class(F.col("trend"), F.col("total"), F.col("latest"))
    )
