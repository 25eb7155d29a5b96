"""Numbers: rounding, clamping and safe ratios, the same in every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, places: int) -> Column:
    """floor(x * 10^places + 0.5) / 10^places: halves go up, also below zero; null stays null."""
    scale = F.lit(float(10**places))
    return F.floor(x * scale + F.lit(0.5)) / scale


def clamp(x: Column, low: float, high: float) -> Column:
    """``x`` held between two bounds; null stays null (``greatest`` alone would drop it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null where whole is 0 or null."""
    return F.when(whole != 0, part / whole)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
