"""Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamped(value: Column, low: float | Column | None, high: float | Column | None) -> Column:
    """The value inside the bounds; null stays null (``least`` and ``greatest`` alone would skip it)."""
    out = value
    if low is not None:
        out = F.greatest(out, F.lit(low) if not isinstance(low, Column) else low)
    if high is not None:
        out = F.least(out, F.lit(high) if not isinstance(high, Column) else high)
    return F.when(value.isNotNull(), out)
