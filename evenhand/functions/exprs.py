"""Column expressions that fix the library's null, NaN and rounding rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def valid(value: Column) -> Column:
    """Neither null nor NaN; infinities are values."""
    return value.isNotNull() & ~F.isnan(value)


def r6(value: Column, digits: int = 6) -> Column:
    return F.round(value.cast("double"), digits)


def half_even(value: Column) -> Column:
    """A double rounded to a whole number, halves to even, as a long."""
    return F.bround(value, 0).cast("long")


def nearest_index(n: Column, q: float) -> Column:
    """0-based index of the nearest-rank quantile among n sorted values."""
    return F.floor((n - 1) * F.lit(q) + 0.5).cast("long")


def seeded(seed: str, key: Column) -> Column:
    """Order key of reproducible shuffles: md5 of 'seed:key'."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))
