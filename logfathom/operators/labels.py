"""Label names, label values, and the distribution of values per label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfathom.operators.select import check_limit, label
from logfathom.operators.topk import top_k

# Caps on listed values.
DEFAULT_VALUES = 50
TOP_VALUES = 15
INTERNAL_PREFIX = "__"


def label_names(logs: DataFrame, scope: Sequence[str] = (), *, internal: bool = False) -> DataFrame:
    """Distinct label names. Rows collapse to distinct name sets first, so few rows are exploded.

    Names starting with two underscores are internal and left out unless asked for.
    """
    present = F.map_keys(F.map_filter("labels", lambda k, v: v.isNotNull()))
    sets = logs.select(*scope, F.sort_array(present).alias("names")).distinct()
    names = sets.select(*scope, F.explode("names").alias("label")).distinct()
    if not internal:
        names = names.where(~F.col("label").startswith(INTERNAL_PREFIX))
    return names.orderBy(*scope, "label")


def ranked_values(logs: DataFrame, name: str, scope: Sequence[str], contains: str | Column | None, limit: int | None) -> DataFrame:
    """Values in text order, matching ones first, with totals before and after the filter, which may be a column of the scope."""
    values = logs.select(*scope, label(name).alias("value")).where(F.col("value").isNotNull()).distinct()
    some = isinstance(contains, Column) or bool(contains)
    hit = F.contains(F.lower("value"), F.lower(F.lit(contains))) if some else F.lit(True)
    marked = values.withColumn("hit", hit)
    totals = {"total_values": F.col("hit").cast("int"), "total_label_values": F.lit(1)}
    return top_k(marked, scope, [F.col("hit").desc(), F.col("value").asc()], limit, totals)


def label_values(
    logs: DataFrame, name: str, scope: Sequence[str] = (), *, contains: str | None = None, limit: int | None = DEFAULT_VALUES
) -> DataFrame:
    """Values of one label, filtered by a case-insensitive substring and capped, with exact totals."""
    if not name:
        raise ValueError("a label name is required")
    n = check_limit(limit)
    shown = ranked_values(logs, name, scope, contains, n).where("hit")
    truncated = F.lit(False) if n is None else F.col("total_values") > n
    return shown.select(*scope, "rank", "value", "total_values", "total_label_values", truncated.alias("truncated"))


def count_label_values(logs: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Rows per (scope, label, value) for all labels at once; only labels and scope are read."""
    pairs = logs.select(*scope, F.explode("labels").alias("label", "value"))
    kept = pairs.where(F.col("value").isNotNull() & ~F.col("label").startswith(INTERNAL_PREFIX))
    return kept.groupBy(*scope, "label", "value").agg(F.count("*").alias("count"))


def label_distribution(logs: DataFrame, scope: Sequence[str] = (), *, top: int = TOP_VALUES) -> DataFrame:
    """The most frequent values of every label with more than one value, and how many were left out."""
    order = [F.col("count").desc(), F.col("value").asc()]
    totals = {"distinct_values": F.lit(1)}
    ranked = top_k(count_label_values(logs, scope), [*scope, "label"], order, top, totals)
    omitted = F.greatest(F.col("distinct_values") - top, F.lit(0))
    several = ranked.where(F.col("distinct_values") > 1)
    return several.select(*scope, "label", "rank", "value", "count", "distinct_values", omitted.alias("omitted_values"))
