"""Top-k per scope together with exact totals, without collecting a scope into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scope_window(scope: Sequence[str]):
    return Window.partitionBy(*scope) if scope else Window.partitionBy(F.lit(0))


def whole_rows(df: DataFrame) -> DataFrame:
    """The same rows, with all columns read by whatever follows. Two uses of ``df`` then need the same columns of it, so
    Spark computes its shuffle once and reuses it; without this each use would prune its own columns and run apart."""
    plain = [name for name, kind in df.dtypes if "map<" not in kind]  # maps have no hash
    return df.where(F.xxhash64(*plain) >= F.lit(-(2**63)))


def with_totals(ranked: DataFrame, totals: DataFrame, scope: Sequence[str], rank: str) -> DataFrame:
    """Ranked rows of each scope with the columns of its one row of ``totals``, null scopes included.

    The totals travel as one more row per scope and are spread by a window over
    the scope's ranked rows, so an empty scope needs no join without a key.
    """
    names = [c for c in totals.columns if c not in scope]
    named = ranked.select(*[F.col(c).alias(c) for c in ranked.columns])  # a union fixes its first side's aliases, so give it some of its own
    both = named.unionByName(totals, allowMissingColumns=True)
    return both.withColumns({n: F.max(n).over(scope_window(scope)) for n in names}).where(F.col(rank).isNotNull())


def top_k(
    df: DataFrame, scope: Sequence[str], order: Sequence[Column], k: int | None, totals: dict[str, Column], *, rank: str = "rank"
) -> DataFrame:
    """Rows ranked 1..k per scope plus whole-scope sums.

    ``df`` holds one row per (scope, item). Sums are partial aggregates; ranks run
    under a window group limit. Both reduce a scope in every task before the
    shuffle, so a scope of any size sends at most ``k`` rows and one sum per task.
    """
    rows = whole_rows(df)
    sums = rows.groupBy(*scope).agg(*[F.sum(v).alias(n) for n, v in totals.items()])
    return with_totals(first_k(rows, scope, order, k, rank=rank), sums, scope, rank)


def first_k(df: DataFrame, scope: Sequence[str], order: Sequence[Column], k: int | None, *, rank: str = "rank") -> DataFrame:
    """Rows ranked 1..k per scope, or all of them ranked. Each task keeps its own first k before the shuffle (window group limit)."""
    ranked = df.withColumn(rank, F.row_number().over(scope_window(scope).orderBy(*order)))
    return ranked if k is None else ranked.where(F.col(rank) <= k)
