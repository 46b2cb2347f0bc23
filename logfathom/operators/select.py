"""Selection: label matchers, line filters, time bounds, order and limit."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfathom.functions.clock import ntz, to_micros
from logfathom.functions.text import cap_line, is_whole, whole_json
from logfathom.operators.topk import first_k

# Request limits and the size of the evidence sample.
DEFAULT_LIMIT = 100
SAMPLE_ROWS = 5
DEFAULT_LABEL = "service_name"

Matcher = tuple[str, str, str]


def label(name: str, labels: str = "labels") -> Column:
    return F.col(labels)[name]


def match_label(name: str, op: str, value: str, labels: str = "labels") -> Column:
    """One matcher ``= != =~ !~``. Regexes match the whole value and an absent label equals ''.

    Equality with a non-empty value stays a bare comparison, which a Parquet scan can use.
    """
    found = label(name, labels)
    if op == "=":
        return found == value if value else found.isNull() | (found == "")
    if op == "!=":
        return found.isNull() | (found != value) if value else found != ""
    if op in ("=~", "!~"):
        hit = F.coalesce(found, F.lit("")).rlike(rf"\A(?:{value})\z")
        return hit if op == "=~" else ~hit
    raise ValueError(f"unknown matcher {op!r}")


def json_compare(path: str, op: str, number: float, line: str = "line") -> Column:
    """Numeric comparison on a JSON field; lines that are not JSON as a whole or lack the field do not match."""
    doc = whole_json(F.col(line))
    field = F.when(is_whole(doc), F.try_variant_get(doc, f"$[0].{path}", "double"))
    tests = {
        "=": field == number, "!=": field != number, ">": field > number,
        ">=": field >= number, "<": field < number, "<=": field <= number,
    }
    if op not in tests:
        raise ValueError(f"unknown comparison {op!r}")
    return tests[op]


def line_filter(
    *,
    contains: Iterable[str] = (),
    excludes: Iterable[str] = (),
    regex: Iterable[str] = (),
    not_regex: Iterable[str] = (),
    line: str = "line",
) -> Column | None:
    """AND of substring and regex tests on the line; None when there are none."""
    text = F.col(line)
    regex, not_regex = list(regex), list(not_regex)
    if any(r in (".*", ".+") for r in regex):
        raise ValueError("a line regex that matches everything is not a filter")
    tests = [F.contains(text, F.lit(s)) for s in contains]
    tests += [~F.contains(text, F.lit(s)) for s in excludes]
    tests += [text.rlike(r) for r in regex]
    tests += [~text.rlike(r) for r in not_regex]
    return reduce(lambda a, b: a & b, tests) if tests else None


def between(logs: DataFrame, start: str | datetime | None, end: str | datetime | None, ts: str = "ts") -> DataFrame:
    """Rows with start <= ts < end. A ``day`` date column, as ``write_logs`` makes it, is bounded too, so only those days are read."""
    daily = dict(logs.dtypes).get("day") == "date"
    if daily and start is not None:
        logs = logs.where(F.col("day") >= ntz(start).cast("date"))
    if daily and end is not None:
        logs = logs.where(F.col("day") <= ntz(end).cast("date"))
    if start is not None:
        logs = logs.where(F.col(ts) >= ntz(start))
    if end is not None:
        logs = logs.where(F.col(ts) < ntz(end))
    return logs


def select_logs(
    logs: DataFrame,
    matchers: Sequence[Matcher] | None = None,
    *,
    contains: Iterable[str] = (),
    excludes: Iterable[str] = (),
    regex: Iterable[str] = (),
    not_regex: Iterable[str] = (),
    json: Sequence[tuple[str, str, float]] = (),
    start: str | datetime | None = None,
    end: str | datetime | None = None,
    default_label: str = DEFAULT_LABEL,
) -> DataFrame:
    """The log selection. Without matchers every row that carries ``default_label`` is taken."""
    selected = between(logs, start, end)
    for name, op, value in matchers or [(default_label, "!=", "")]:
        selected = selected.where(match_label(name, op, value))
    lines = line_filter(contains=contains, excludes=excludes, regex=regex, not_regex=not_regex)
    if lines is not None:
        selected = selected.where(lines)
    for path, op, number in json:
        selected = selected.where(json_compare(path, op, number))
    return selected


def check_limit(limit: int | None) -> int | None:
    """The limit as given; None means no cut."""
    if limit is not None and limit < 1:
        raise ValueError(f"a limit is a positive number or None, not {limit!r}")
    return limit


def newest_first(direction: str | None) -> bool:
    """'forward' is oldest first; anything else is newest first."""
    return direction != "forward"


def time_order(direction: str | Column | None, ts: str = "ts", tie: str = "id") -> list[Column]:
    """Sort columns for a direction, which may differ by row; equal times fall back to the row id so the order is total."""
    if isinstance(direction, Column):
        return [c.asc() for c in signed_time(direction, ts, tie)]
    if newest_first(direction):
        return [F.col(ts).desc(), F.col(tie).desc()]
    return [F.col(ts).asc(), F.col(tie).asc()]


def signed_time(direction: Column, ts: str = "ts", tie: str = "id") -> list[Column]:
    """Time and row id, negative where the direction is not forward, so that the smallest come first either way."""
    sign = F.when(direction == "forward", 1).otherwise(-1)
    return [sign * to_micros(F.col(ts)), sign * F.col(tie)]


def take_logs(
    logs: DataFrame, *, limit: int | None = DEFAULT_LIMIT, direction: str | None = None, scope: Sequence[str] = ()
) -> DataFrame:
    """The first rows in time order: one sort overall, or ``rank`` <= limit inside each scope. No limit keeps all rows."""
    n = check_limit(limit)
    if not scope:
        ordered = logs.orderBy(*time_order(direction))
        return ordered if n is None else ordered.limit(n)
    return first_k(logs, scope, time_order(direction), n)


def sample_logs(logs: DataFrame, scope: Sequence[str] = (), *, direction: str | Column | None = None, n: int = SAMPLE_ROWS) -> DataFrame:
    """The first rows of each scope as evidence, with long lines cut."""
    return first_k(logs, scope, time_order(direction), n).withColumn("line", cap_line(F.col("line")))


def count_selected(logs: DataFrame, scope: Sequence[str] = (), *, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """Rows matched, rows a request would return, and whether its limit was reached."""
    n = check_limit(limit)
    counted = logs.groupBy(*scope).agg(F.count("*").alias("matched"))
    returned, truncated = limited(F.col("matched"), n)
    return counted.select(*scope, "matched", returned.alias("total_logs"), truncated.alias("truncated"))


def limited(matched: Column, limit: int | Column | None) -> tuple[Column, Column]:
    """Rows returned of those matched, and whether the limit was reached; a null limit is none."""
    if limit is None:
        return matched, F.lit(False)
    most = F.lit(limit).cast("bigint")
    return F.least(matched, most), F.coalesce(matched >= most, F.lit(False))
