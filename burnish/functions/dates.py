"""Calendar expressions over timestamps without time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from burnish.functions.columns import DAY_MICROS, flag, wall_micros


def time_of_day(stamp: Column) -> Column:
    hour = F.hour(stamp)
    return (
        F.when(hour <= 6, "night").when(hour <= 12, "morning").when(hour <= 18, "afternoon").when(hour <= 23, "evening")
    )


def whole_days_since(stamp: Column, start_micros: int) -> Column:
    """Full 24-hour days between a fixed start and the stamp."""
    return F.floor((wall_micros(stamp) - F.lit(start_micros)) / F.lit(DAY_MICROS)).cast("long")


CALENDAR = {
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "dayofweek": F.weekday,
    "hour": F.hour,
    "minute": F.minute,
    "is_weekend": lambda stamp: flag(F.weekday(stamp) >= 5),
    "quarter": F.quarter,
    "week_of_year": F.weekofyear,
    "time_of_day": time_of_day,
}
