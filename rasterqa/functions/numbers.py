"""Small numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def luminance(r="r", g="g", b="b") -> Column:
    """Rec. 601 luminance, weighed in whole thousandths so equal greys stay exact."""
    return (F.col(r) * 299 + F.col(g) * 587 + F.col(b) * 114) / 1000


def half_even(col: Column, digits: int = 0) -> Column:
    """Round to decimals as the exact binary value demands, true ties to even.

    Scaling by a power of ten can land on a tie that the value itself misses by a hair;
    the scaling error, recovered by splitting the factor, then decides the direction.
    """
    if digits == 0:
        return F.rint(col.cast("double")) + 0.0
    # Bound to a lambda variable so that the input is written, and evaluated, once.
    exact = F.transform(F.array(col.cast("double")), lambda x: _exact_round(x, 10**digits))
    return F.get(exact, F.lit(0))


def _exact_round(x: Column, power: int) -> Column:
    twice = 2.0 * power
    scaled = x * twice
    carry = x * 134217729.0
    high = carry - (carry - x)
    error = (high * twice - scaled) + (x - high) * twice
    tie = F.abs(scaled % 2) == 1
    whole = (
        F.when(tie & (error < 0), (scaled - 1) / 2)
        .when(tie & (error > 0), (scaled + 1) / 2)
        .otherwise(F.rint(scaled / 2))
    )
    return whole / float(power) + 0.0


def px_to_mm(px: Column, dpi: Column) -> Column:
    return F.when(dpi > 0, px / dpi * 25.4).otherwise(F.lit(0.0))


def finite(col: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(F.isnan(col) | (F.abs(col) == F.lit(float("inf"))), None).otherwise(col)


def count_where(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")


def share_where(cond: Column) -> Column:
    """Fraction of rows for which ``cond`` holds (NULL over no rows)."""
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def clamp01(col: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col))


def orientation(w: Column, h: Column) -> Column:
    return F.when(w == h, "Square").when(w > h, "Landscape").otherwise("Portrait")


def fixed(col: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, ties to even."""
    return F.format_string(f"%.{digits}f", half_even(col, digits))
