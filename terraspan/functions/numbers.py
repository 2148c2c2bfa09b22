"""Scalar rules on columns: rounding, wrapping, clamping, easing.

Nulls give null unless stated. ``clamp`` skips nulls like Spark's greatest and least.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_up(c: Column) -> Column:
    """Nearest whole number, halves towards positive infinity (-2.5 gives -2)."""
    return F.floor(c + 0.5)


def rounded(c: Column, places: int) -> Column:
    """Decimal rounding for output, halves away from zero."""
    return F.round(c, places)


def wrap16(c: Column) -> Column:
    """A whole number reduced to the signed 16-bit range, without overflow."""
    return F.pmod(c + 32768, F.lit(65536)) - 32768


def wrap(value: Column, period) -> Column:
    """The positive remainder."""
    return F.pmod(value, F.lit(period) if not isinstance(period, Column) else period)


def clamp(c: Column, low, high) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.least(lit(high), F.greatest(lit(low), c))


def clamp01(c: Column) -> Column:
    return clamp(c, 0.0, 1.0)


def smoothstep(t: Column) -> Column:
    return t * t * (3 - 2 * t)


def eased(u: Column, ease=None) -> Column:
    """Clamps to [0, 1], then applies ``ease`` (a function of columns), if any."""
    clamped = clamp01(u)
    return ease(clamped) if ease else clamped


def micro(c: Column) -> Column:
    """Millionths as a whole number: how results are compared across engines."""
    return F.floor(c * 1e6 + 0.5).cast("long")
