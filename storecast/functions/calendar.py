"""Calendar column functions: parsing, calendar features, period keys, date ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAINS = ("daily", "weekly", "monthly")


def parse_date(s: Column) -> Column:
    """Strict ``%Y-%m-%d`` parse; unpadded month/day accepted, anything else null."""
    return F.try_to_date(s, "yyyy-M-d")


def week_key(d: Column) -> Column:
    """``%Y-W%U``: Sunday-based week of the year, 00-53 (days before the first
    Sunday are week 00)."""
    w = F.floor((F.dayofyear(d) + 7 - F.dayofweek(d)) / 7).cast("int")
    return F.concat(F.year(d).cast("string"), F.lit("-W"), F.lpad(w.cast("string"), 2, "0"))


def period_key(grain: str, d: Column) -> Column:
    if grain == "daily":
        return F.date_format(d, "yyyy-MM-dd")
    if grain == "weekly":
        return week_key(d)
    if grain == "monthly":
        return F.date_format(d, "yyyy-MM")
    raise ValueError(grain)


def calendar_columns(d: Column) -> dict[str, Column]:
    """Weekday (Monday = 0), month, year, day of month."""
    return {
        "day_of_week": F.weekday(d),
        "month": F.month(d),
        "year": F.year(d),
        "day_of_month": F.dayofmonth(d),
    }


def day_range(start: Column, days: int) -> Column:
    """Array of ``days`` consecutive dates from ``start``."""
    return F.sequence(start, F.date_add(start, days - 1))
