"""Zone-free time arithmetic: TIMESTAMP_NTZ read as UTC, and its microsecond epoch."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000

_UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def ntz(value: str | datetime | Column) -> Column:
    """A TIMESTAMP_NTZ literal (foldable, so comparisons reach the scan) or the column unchanged."""
    if isinstance(value, Column):
        return value
    text = value.isoformat(sep=" ") if isinstance(value, datetime) else value
    return F.lit(text).cast("timestamp_ntz")


def to_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def nanos_to_ntz(ns: Column) -> Column:
    """Nanosecond epoch (number or text) to a timestamp; bad text gives NULL."""
    whole = ns.cast("string").try_cast("bigint")
    return from_micros(floor_div(whole, 1000))


def ntz_to_nanos(ts: Column) -> Column:
    return to_micros(ts) * F.lit(1000)


def floor_div(value: Column, divisor: int | Column) -> Column:
    """Integer division rounding down, also for times before 1970."""
    d = F.lit(divisor)
    return F.call_function("div", value - F.pmod(value, d), d)


def ceil_to(value: Column, step: int | Column) -> Column:
    """Smallest multiple of ``step`` that is >= value."""
    s = F.lit(step)
    return value + F.pmod(s - F.pmod(value, s), s)


def span_micros(span: str | int | float | timedelta) -> int:
    """A driver-side span ('5m', '1h30m', seconds, timedelta) in microseconds."""
    if isinstance(span, timedelta):
        micros = span // timedelta(microseconds=1)
    elif isinstance(span, (int, float)):
        micros = int(span * MICROS)
    else:
        parts = re.findall(r"(\d+)([smhdw])", span)
        if not parts or "".join(a + u for a, u in parts) != span:
            raise ValueError(f"bad span {span!r}")
        micros = sum(int(a) * _UNIT_SECONDS[u] for a, u in parts) * MICROS
    if micros <= 0:
        raise ValueError("a span must be positive")
    return micros
