"""Numeric helpers: half-up rounding, medians and slopes with defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """Round halves towards plus infinity (-2.5 gives -2), unlike ``round``."""
    k = 10**digits
    return F.floor(x * k + 0.5) / k


def median0(x: Column) -> Column:
    return F.coalesce(F.median(x), F.lit(0.0))


def slope_pct(y: Column, x: Column) -> Column:
    """Least-squares slope of y on x as a percentage of y's mean; 0 where undefined."""
    return half_up(F.coalesce(F.when(F.avg(y) != 0, F.regr_slope(y, x) / F.avg(y) * 100), F.lit(0.0)), 1)


def min_max(x: Column, over) -> Column:
    """0..1 over the window; 0.5 where all are equal, null for null."""
    lo, hi = F.min(x).over(over), F.max(x).over(over)
    return F.when(x.isNull(), None).when(hi == lo, 0.5).otherwise((x - lo) / (hi - lo))
