"""Time expressions, defaults and steps as column expressions. "Now" is always the ``as_of`` column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logfathom.functions.clock import MICROS, floor_div, from_micros, nanos_to_ntz, to_micros
from logfathom.functions.text import trim_space

# Unit spellings of "N unit [ago]" and "last N unit", in seconds.
UNIT_SECONDS = {
    "s": 1, "sec": 1, "second": 1, "seconds": 1,
    "m": 60, "min": 60, "minute": 60, "minutes": 60,
    "h": 3600, "hour": 3600, "hours": 3600,
    "d": 86400, "day": 86400, "days": 86400,
    "w": 604800, "week": 604800, "weeks": 604800,
}
# Units of compound durations, in nanoseconds.
DURATION_NANOS = {
    "ns": 1, "us": 1_000, "µs": 1_000, "μs": 1_000,
    "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000,
}
# Phrases that mean "so many hours back".
PHRASE_HOURS = {"yesterday": 24, "last night": 12, "last week": 168}
# Widest range in minutes that still gets each automatic step.
AUTO_STEPS = ((30, "30s"), (120, "1m"), (360, "5m"), (720, "15m"))
AUTO_STEP_REST = "1h"

_BLANK = r"[\t\n\f\r ]"
_UNITS = "|".join(sorted(UNIT_SECONDS, key=len, reverse=True))
_AGO = rf"\A([0-9]+){_BLANK}*({_UNITS}){_BLANK}*(?:ago)?\z"
_LAST = rf"\Alast{_BLANK}+([0-9]+){_BLANK}*({_UNITS})\z"
_TIME_OF_DAY = rf"\A([0-9]{{1,2}})(?::([0-9]{{2}}))?{_BLANK}*(am|pm)?\z"
_DURATION_PART = r"((?:[0-9]+\.?[0-9]*|\.[0-9]+))(ns|us|µs|μs|ms|s|m|h)"
_DURATION = r"\A[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:ns|us|µs|μs|ms|s|m|h))+\z"
_RFC3339 = (
    r"\A([0-9]{4}-[0-9]{2}-[0-9]{2})[Tt]([0-9]{2}:[0-9]{2}:[0-9]{2})(?:[.,]([0-9]+))?"
    r"(?:[Zz]|([+-])([01][0-9]|2[0-4]):([0-5][0-9]|60))\z"
)
_MAX_NANOS = 9_223_372_036_854_775_807


def _lookup(key: Column, table: dict[str, int]) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def duration_nanos(text: Column) -> Column:
    """Signed compound duration ('1h30m', '1.5h', '-5m', '0') in nanoseconds, NULL when malformed."""
    wide = "decimal(38,9)"
    amounts = F.regexp_extract_all(text, F.lit(_DURATION_PART), F.lit(1))
    units = F.regexp_extract_all(text, F.lit(_DURATION_PART), F.lit(2))
    parts = F.zip_with(
        amounts,
        units,
        lambda a, u: F.floor(a.try_cast("decimal(28,9)") * _lookup(u, DURATION_NANOS).cast("decimal(14,0)")).try_cast(wide),
    )
    total = F.aggregate(parts, F.lit(0).cast(wide), lambda acc, x: F.try_add(acc, x).try_cast(wide))
    signed = F.when(text.startswith("-"), -total).otherwise(total)
    in_range = F.abs(total) <= F.lit(_MAX_NANOS).cast("decimal(38,9)")
    zero = text.rlike(r"\A[+-]?0\z")
    return F.when(zero, F.lit(0).cast("bigint")).when(text.rlike(_DURATION) & in_range, signed.try_cast("bigint"))


def step_minutes(step: Column) -> Column:
    """A step as minutes; 0 when it is not a duration ('1d' is not)."""
    return F.coalesce(duration_nanos(step) / F.lit(60e9), F.lit(0.0))


def auto_step(start: Column, end: Column) -> Column:
    """The step picked for a window when the request names none."""
    minutes = (to_micros(end) - to_micros(start)) / F.lit(60.0 * MICROS)
    chosen = F.lit(AUTO_STEP_REST)
    for widest, step in reversed(AUTO_STEPS):
        chosen = F.when(minutes <= widest, F.lit(step)).otherwise(chosen)
    return chosen


def _back(as_of: Column, seconds: Column) -> Column:
    micros = F.try_multiply(seconds, F.lit(MICROS).cast("bigint"))
    return from_micros(F.try_subtract(to_micros(as_of), micros))


def _spelled(text: Column, pattern: str, as_of: Column) -> Column:
    amount = F.regexp_extract(text, pattern, 1).try_cast("bigint")
    unit = _lookup(F.regexp_extract(text, pattern, 2), UNIT_SECONDS).cast("bigint")
    return F.when(text.rlike(pattern), _back(as_of, F.try_multiply(amount, unit)))


def _at_minute(day: Column, minute: Column) -> Column:
    return from_micros(to_micros(day.cast("timestamp_ntz")) + minute.cast("bigint") * 60 * MICROS)


def minute_of_day(text: Column) -> Column:
    """Minutes after midnight for '2pm', '2:30pm', '14:00', 'noon', 'midnight'; NULL when invalid."""
    clean = trim_space(text)
    hour = F.regexp_extract(clean, _TIME_OF_DAY, 1).try_cast("int")
    minute = F.coalesce(F.regexp_extract(clean, _TIME_OF_DAY, 2).try_cast("int"), F.lit(0))
    half = F.regexp_extract(clean, _TIME_OF_DAY, 3)
    shift = F.when((half == "pm") & (hour < 12), 12).when((half == "am") & (hour == 12), -12).otherwise(0)
    clock = hour + shift
    valid = clean.rlike(_TIME_OF_DAY) & (clock <= 23) & (minute <= 59)
    return (
        F.when(clean == "noon", F.lit(720)).when(clean == "midnight", F.lit(0)).when(valid, clock * 60 + minute)
    )


def _month_back(as_of: Column) -> Column:
    """One calendar month back; a missing day runs over into the next month (31 March -> 2 or 3 March)."""
    day = as_of.cast("date")
    first = F.add_months(F.trunc(day, "month"), -1)
    shifted = F.date_add(first, F.dayofmonth(day) - 1)
    into_day = to_micros(as_of) - to_micros(day.cast("timestamp_ntz"))
    return from_micros(to_micros(shifted.cast("timestamp_ntz")) + into_day)


def _phrase(lower: Column, as_of: Column) -> Column:
    today = as_of.cast("date")
    prior = F.date_sub(today, 1)
    six = _at_minute(today, F.lit(360))
    morning = F.when(six > as_of, _at_minute(prior, F.lit(360))).otherwise(six)
    named = F.when(lower.isin("today", "midnight", "today at midnight", "at midnight"), _at_minute(today, F.lit(0)))
    named = named.when(lower.isin("noon", "today at noon", "at noon"), _at_minute(today, F.lit(720)))
    named = named.when(lower == "this morning", morning).when(lower == "last month", _month_back(as_of))
    for phrase, hours in PHRASE_HOURS.items():
        named = named.when(lower == phrase, _back(as_of, F.lit(hours * 3600).cast("bigint")))
    clock = F.when(lower.startswith("yesterday at "), minute_of_day(F.substring(lower, len("yesterday at ") + 1, 1 << 30)))
    return F.coalesce(named, _spelled(lower, _LAST, as_of), _at_minute(prior, clock))


def _rfc3339(text: Column) -> Column:
    def part(i: int) -> Column:
        return F.regexp_extract(text, _RFC3339, i)

    fraction = F.substring(F.rpad(part(3), 6, "0"), 1, 6)
    local = F.concat(part(1), F.lit(" "), part(2), F.lit("."), fraction).try_cast("timestamp_ntz")
    offset = F.coalesce(part(5).try_cast("bigint") * 3600 + part(6).try_cast("bigint") * 60, F.lit(0))
    ahead = F.when(part(4) == "-", -offset).otherwise(offset)
    return F.when(text.rlike(_RFC3339), from_micros(to_micros(local) - ahead * MICROS))


def resolve_time(text: Column, as_of: Column) -> Column:
    """A time expression as a timestamp relative to ``as_of``; NULL when it cannot be read.

    Tried in order: blank or 'now', 'N unit [ago]', phrases, compound durations, RFC 3339, nanosecond epoch.
    """
    clean = trim_space(text)
    lower = F.lower(clean)
    duration = duration_nanos(lower)
    by_duration = from_micros(floor_div(F.try_subtract(F.try_multiply(to_micros(as_of), F.lit(1000)), duration), 1000))
    epoch = F.when(clean.rlike(r"\A[+-]?[0-9]+\z"), nanos_to_ntz(clean))
    return F.coalesce(
        F.when(lower.isin("", "now"), as_of),
        _spelled(lower, _AGO, as_of),
        _phrase(lower, as_of),
        by_duration,
        _rfc3339(clean),
        epoch,
    )


def time_or_default(text: Column, as_of: Column, hours_back: int) -> Column:
    """``resolve_time``, with an absent expression meaning ``hours_back`` before ``as_of``."""
    absent = text.isNull() | (text == "")
    default = _back(as_of, F.lit(hours_back * 3600).cast("bigint"))
    return F.when(absent, default).otherwise(resolve_time(text, as_of))
