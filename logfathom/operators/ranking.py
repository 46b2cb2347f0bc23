"""Which series a report shows: the largest, plus rescued anomalous ones; what is left out is counted exactly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logfathom.operators.series import downsample

# Report caps.
MAX_SERIES = 20
MAX_RESCUED = 5
MAX_LISTED = 25
MAX_WITH_POINTS = 5

# Pieces a scope is split into before its candidates meet in one task.
SALTS = 64


def salted(items: Sequence[str], salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*[F.col(c) for c in items]), F.lit(salts))


def rank_series(
    summaries: DataFrame,
    scope: Sequence[str],
    keys: Sequence[str],
    *,
    cap: int = MAX_SERIES,
    rescue: int = MAX_RESCUED,
    listed: int = MAX_LISTED,
    salts: int = SALTS,
) -> DataFrame:
    """Candidate series per scope with ``volume_rank``, ``kept``, ``report_rank`` and whole-scope counts.

    Kept are the ``cap`` largest by total. Anomalous series below the cap replace
    stable ones inside it: n = min(rescue, anomalous below, stable inside); the n
    lowest stable ones go, the n highest anomalous ones come in.

    Only the first cap + listed series by total and as many anomalous ones can be
    shown or listed, so each salt piece passes on no more than that: a scope with
    any number of series meets in one task only as a bounded candidate set.
    """
    depth = cap + listed
    order = [F.col("total").desc(), *[F.col(k).asc() for k in keys]]
    odd = F.col("anomaly").isNotNull()
    piece = Window.partitionBy(*scope, "__salt")
    piece_odd = Window.partitionBy(*scope, "__salt", "__odd")
    local = summaries.withColumns({"__odd": odd, "__salt": salted(keys, salts)}).withColumns(
        {
            "__place": F.row_number().over(piece.orderBy(*order)),
            "__odd_place": F.row_number().over(piece_odd.orderBy(*order)),
            "__all": F.count("*").over(piece),
            "__all_odd": F.count(F.when(F.col("__odd"), 1)).over(piece),
        }
    )
    short = local.where((F.col("__place") <= depth) | (F.col("__odd") & (F.col("__odd_place") <= depth)))

    one = list(scope) or [F.lit(0)]
    whole, by_odd, by_kept = Window.partitionBy(*one), Window.partitionBy(*one, "__odd"), Window.partitionBy(*one, "kept")
    lead = F.col("__place") == 1
    ranked = short.withColumns(
        {
            "volume_rank": F.row_number().over(whole.orderBy(*order)),
            "__odd_rank": F.row_number().over(by_odd.orderBy(*order)),
            "total_series": F.sum(F.when(lead, F.col("__all"))).over(whole),
            "anomalous_series": F.sum(F.when(lead, F.col("__all_odd"))).over(whole),
        }
    )
    inside = F.col("volume_rank") <= cap
    swapped = ranked.withColumns(
        {
            "__stable_in": F.count(F.when(inside & ~F.col("__odd"), 1)).over(whole),
            "__odd_in": F.count(F.when(inside & F.col("__odd"), 1)).over(whole),
        }
    )
    n = F.least(F.lit(rescue), F.col("anomalous_series") - F.col("__odd_in"), F.col("__stable_in"))
    kept = F.when(F.col("__odd"), F.col("__odd_rank") <= F.col("__odd_in") + n).otherwise(
        inside & (F.col("__odd_rank") <= F.col("__stable_in") - n)
    )
    marked = swapped.withColumn("kept", kept)
    place = F.row_number().over(by_kept.orderBy(*order))
    placed = marked.withColumn("report_rank", F.when(F.col("kept"), place))
    placed = placed.where((F.col("volume_rank") <= depth) | (F.col("__odd") & (F.col("__odd_rank") <= depth)))
    extra = ["volume_rank", "kept", "report_rank", "total_series", "anomalous_series"]
    return placed.select(*[c for c in summaries.columns if c not in extra], *extra)


def reported_series(ranked: DataFrame) -> DataFrame:
    """The kept series in report order."""
    return ranked.where("kept")


def omitted_columns(key: str, *, listed: int = MAX_LISTED) -> list[Column]:
    """Aggregates over ranked candidates: series left out, anomalous ones left out, and the first keys of each."""
    left = ~F.col("kept")
    entry = F.struct(F.col("volume_rank").alias("rank"), F.col(key).alias("key"))

    def first_keys(condition: Column) -> Column:
        gathered = F.sort_array(F.collect_list(F.when(condition, entry)))
        return F.transform(F.slice(gathered, 1, listed), lambda e: e["key"])

    def left_out(whole: str, shown: Column) -> Column:
        return F.coalesce(F.max(whole), F.lit(0)) - F.count(F.when(shown, 1))

    odd = F.col("anomaly").isNotNull()
    return [
        F.coalesce(F.max("total_series"), F.lit(0)).alias("total_series"),
        left_out("total_series", F.col("kept")).alias("omitted_series"),
        first_keys(left).alias("omitted_keys"),
        left_out("anomalous_series", F.col("kept") & odd).alias("omitted_anomalous"),
        first_keys(left & odd).alias("omitted_anomalous_keys"),
    ]


def omitted_series(ranked: DataFrame, scope: Sequence[str], key: str, *, listed: int = MAX_LISTED) -> DataFrame:
    """Per scope: how many series (and anomalous ones) are left out, and the first keys of each in volume order."""
    return ranked.groupBy(*scope).agg(*omitted_columns(key, listed=listed))


def evidence_points(
    points: DataFrame, ranked: DataFrame, join_on: Sequence[str], *, first: int = MAX_WITH_POINTS
) -> DataFrame:
    """Down-sampled raw points of the first reported series. ``points`` carry ``idx`` and ``n_points``."""
    top = ranked.where(F.col("kept") & (F.col("report_rank") <= first)).select(*join_on, "report_rank")
    return downsample(points).join(top, list(join_on))
