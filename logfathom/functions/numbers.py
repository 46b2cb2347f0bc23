"""Rounding and strict number parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DECIMAL = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_HEX = r"[+-]?0[xX](?:[0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?[0-9]+"


def round_scaled(value: Column, digits: int) -> Column:
    """Scale, round half away from zero, scale back (``round(x, 2)`` turns 1.005 into 1.01)."""
    factor = float(10**digits)
    return F.round(value * factor) / factor


def finite(value: Column) -> Column:
    """The number, or NULL for NaN and the infinities."""
    keep = ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    return F.when(keep, value)


def strict_double(text: Column) -> Column:
    """Parse a whole string as a finite number; blanks, suffixes, NaN and overflow give NULL."""
    shaped = text.rlike(rf"\A(?:{_DECIMAL}|{_HEX})\z")
    return finite(F.when(shaped, text.try_cast("double")))


def exact_sum(value: Column, kind: str) -> Column:
    """A sum that does not depend on the order rows arrive in.

    Whole numbers add exactly; doubles add as decimals with ten places, or with
    25 when all are below a thousandth, and fall back to floating point when a
    value or the sum is too large or too small for that.
    """
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.sum(value.cast("bigint")).cast("double")
    largest = F.max(F.abs(value))
    fixed = F.try_sum(value.try_cast("decimal(28,10)")).cast("double")
    fine = F.try_sum((value * 1e15).try_cast("decimal(28,10)")).cast("double") / 1e15
    exact = F.when(largest < 1e-3, fine).otherwise(fixed)
    lost = (exact == 0) & (largest > 0)
    return F.when((largest >= 1e17) | lost, F.sum(value)).otherwise(F.coalesce(exact, F.sum(value)))
