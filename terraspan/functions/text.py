"""Readings as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import round_up


def fixed(c: Column, places: int) -> Column:
    """With so many decimals, by the number's own bits; halves go to the even digit, as in SQL and C (``format_string`` takes halves of the shortest decimal up)."""
    return F.call_function("format_number", c.cast("double"), F.lit("0." + "0" * places if places else "0"))


def compass(degrees: Column, positive: str, negative: str) -> Column:
    """Such as 51.5°N: the hemisphere's letter carries the sign."""
    return F.concat(fixed(F.abs(degrees), 1), F.lit("°"), F.when(degrees < 0, negative).otherwise(positive))


def whole_latitude(degrees: Column) -> Column:
    """Such as 52°N; the equator is north."""
    return F.concat(fixed(F.abs(degrees), 0), F.lit("°"), F.when(degrees >= 0, "N").otherwise("S"))


def count(c: Column) -> Column:
    return F.format_number(c, 0)


def spacing(level: Column) -> Column:
    """Ground covered by a sample at the equator."""
    km = F.lit(40_075.0) / (512 * F.pow(F.lit(2.0), level))
    return F.concat(F.when(km >= 10, round_up(km).cast("string")).otherwise(fixed(km, 1)), F.lit(" km"))


def tenth(c: Column) -> Column:
    return round_up(c * 10) / 10.0


def megabytes(c: Column) -> Column:
    """Kibibytes below a mebibyte, else mebibytes with two decimals."""
    mega = F.lit(1024.0 * 1024.0)
    return F.when(c >= mega, F.concat(fixed(c / mega, 2), F.lit(" MB"))).otherwise(F.concat(fixed(c / 1024.0, 0), F.lit(" kB")))


def rgb(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("rgb("), r.cast("string"), F.lit(","), g.cast("string"), F.lit(","), b.cast("string"), F.lit(")"))


def font(weight: Column, size: Column, family: Column) -> Column:
    return F.concat(F.coalesce(weight.cast("string"), F.lit("500")), F.lit(" "), F.coalesce(size, F.lit(12)).cast("string"), F.lit("px "), family)
