"""ANSI-safe arithmetic: what is unknown or divided by zero becomes a stated value, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def num(c: Column) -> Column:
    """As double; unparsable text is null."""
    return c.try_cast("double")


def div(a: Column, b: Column, default: float | None = 0.0) -> Column:
    """a / b, or the default where b is 0 or either is null."""
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if default is None else F.coalesce(out, F.lit(default))


def pct(a: Column, b: Column) -> Column:
    return div(a, b) * 100


def scrub(c: Column) -> Column:
    """NaN, infinities and null become 0."""
    x = F.nanvl(c.cast("double"), F.lit(0.0))
    return F.coalesce(F.when(F.abs(x) != float("inf"), x), F.lit(0.0))


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def positive(c: Column) -> Column:
    """Null unless above 0, so that averages skip it."""
    return F.when(c > 0, c)
