"""Rounding, clamping and number coercion as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from timeline_lake.functions._columns import ColumnOrName, col


def round_half_away(value: ColumnOrName, digits: int) -> Column:
    """``round(x * 10^n) / 10^n``. Not ``round(x, n)``, which rounds the decimal text of ``x`` instead."""
    scale = float(10**digits)
    return F.round(col(value) * F.lit(scale)) / F.lit(scale)


def clamp(value: ColumnOrName, low: float, high: float) -> Column:
    return F.least(F.greatest(col(value), F.lit(low)), F.lit(high))


def even_floor(value: ColumnOrName) -> Column:
    """Largest even whole number at or below a positive value, as encoders require."""
    return F.floor(col(value) / F.lit(2.0)).cast("double") * F.lit(2.0)


def to_number(text: ColumnOrName) -> Column:
    """Double from a number or numeric text; null when it is neither."""
    return col(text).try_cast("double")


def finite_or_zero(value: ColumnOrName) -> Column:
    """JSON has no NaN or infinity, so both leave as 0. Null stays null."""
    c = col(value)
    bad = F.isnan(c) | (c == F.lit(float("inf"))) | (c == F.lit(float("-inf")))
    return F.when(bad, F.lit(0.0)).otherwise(c)


def lerp(left: ColumnOrName, right: ColumnOrName, share: ColumnOrName) -> Column:
    return col(left) + (col(right) - col(left)) * col(share)
