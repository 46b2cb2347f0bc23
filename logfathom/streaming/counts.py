"""Counts over time on a streaming log table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfathom.functions.clock import MICROS, span_micros
from logfathom.operators.series import Span, label_columns


def streaming_count_over_time(
    logs: DataFrame, keys: Sequence[str], step: Span, *, late: str, range_: Span | None = None
) -> DataFrame:
    """Rows per series and range as each range closes; a point at ``t`` covers ``(t - range, t]``.

    Rows later than ``late`` behind the newest are not counted, so the caller has to say how late rows may be.

    State is one count per open (series, range). The one-microsecond shift that
    makes ranges closed at the right is a column of its own, and the watermark sits on it (as TIMESTAMP, which watermarks need).
    """
    step_us = span_micros(step)
    range_us = span_micros(range_) if range_ is not None else step_us
    shifted = F.col("ts").cast("timestamp") - F.expr("INTERVAL '0.000001' SECOND")
    keyed = logs.select(*label_columns(logs, keys), shifted.alias("tw")).withWatermark("tw", late)
    seconds = [f"{us / MICROS:.6f} seconds" for us in (range_us, step_us)]
    counted = keyed.groupBy(*keys, F.window("tw", *seconds)).agg(F.count("*").alias("value"))
    return counted.select(*keys, F.col("window.end").cast("timestamp_ntz").alias("ts"), "value")
