"""Message patterns: group by signature, share, sample, top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfathom.functions.text import cap_short, signature, with_message
from logfathom.operators.select import newest_first, signed_time
from logfathom.operators.topk import top_k

# Patterns shown, and rows needed before patterns are worth showing.
TOP_PATTERNS = 10
MIN_ROWS = 3


def with_pattern(logs: DataFrame) -> DataFrame:
    """Add ``message`` and its ``pattern``."""
    return with_message(logs).withColumn("pattern", signature(F.col("message")))


def count_patterns(logs: DataFrame, scope: Sequence[str] = (), *, direction: str | Column | None = None) -> DataFrame:
    """One row per (scope, pattern): count and the first message in report order.

    The message is cut to sample size first, so partial aggregation ships short rows;
    a dominant pattern is combined inside each task before the shuffle.
    """
    by_row = isinstance(direction, Column)
    place = F.struct(*signed_time(direction)) if by_row else F.struct("ts", "id")
    shaped = with_pattern(logs).select(*scope, "pattern", cap_short(F.col("message")).alias("m"), place.alias("at"))
    pick = F.min_by if by_row or not newest_first(direction) else F.max_by
    return shaped.groupBy(*scope, "pattern").agg(F.count("*").alias("count"), pick("m", "at").alias("sample"))


def top_patterns(
    logs: DataFrame,
    scope: Sequence[str] = (),
    *,
    k: int = TOP_PATTERNS,
    direction: str | Column | None = None,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """The k most frequent patterns per scope; equal counts go by pattern text. Long patterns are cut for display only."""
    totals = {"total_rows": F.col("count"), "total_patterns": F.lit(1)}
    order = [F.col("count").desc(), F.col("pattern").asc()]
    ranked = top_k(count_patterns(logs, scope, direction=direction), scope, order, k, totals)
    share = F.round(F.col("count") / F.col("total_rows") * 1000) / 10
    shown = ranked.where(F.col("total_rows") >= min_rows)
    return shown.select(*scope, "rank", cap_short(F.col("pattern")).alias("pattern"), "count", share.alias("pct"), "sample", "total_rows", "total_patterns")
