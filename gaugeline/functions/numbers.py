"""Null-safe ratios and fixed-scale rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double, null when the whole is 0 or either side is null."""
    return F.when(whole != 0, part.cast("double") / whole.cast("double"))


def half_up(value: Column, digits: int = 0) -> Column:
    """Round half up for values >= 0 with plain double arithmetic, so that engines agree bit by bit."""
    scale = float(10**digits)
    return F.floor(value * scale + F.lit(0.5)).cast("double") / F.lit(scale)


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, 0 when there is nothing to divide by."""
    return F.coalesce(half_up(ratio(part, whole) * 100.0), F.lit(0.0)).cast("int")


def cut_text(text: Column, limit: int, tail: str = "...") -> Column:
    """Texts longer than ``limit`` end in ``tail`` and keep the length ``limit``."""
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit - len(tail)), F.lit(tail))
    ).otherwise(text)
