"""Date parsing and the whole-day / month arithmetic shared by every horizon rule."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, types as T

DAYS_PER_MONTH = 30.4375
MICROS_PER_DAY = 86_400_000_000


def parse_visit_date(col: Column | str) -> Column:
    """Timestamp or null; text that is no date never raises."""
    return F.try_to_timestamp(F.col(col) if isinstance(col, str) else col)


def is_calendar_date(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, T.DateType)


def instant(df: DataFrame, col: str) -> Column:
    """A date column as whole days, a timestamp column as microseconds (both BIGINT)."""
    if is_calendar_date(df, col):
        return F.unix_date(F.col(col)).cast("bigint")
    c = F.col(col)
    if isinstance(df.schema[col].dataType, T.TimestampNTZType):
        # Built from the wall-clock fields, so no session time zone can shift a day.
        clock = F.hour(c) * F.lit(3600) + F.minute(c) * F.lit(60)
        micros = (F.date_part(F.lit("SECOND"), c) * F.lit(1_000_000)).cast("bigint")
        return F.unix_date(c.cast("date")).cast("bigint") * F.lit(MICROS_PER_DAY) + clock.cast("bigint") * F.lit(1_000_000) + micros
    return F.unix_micros(c)


def ticks_per_day(df: DataFrame, col: str) -> int:
    return 1 if is_calendar_date(df, col) else MICROS_PER_DAY


def whole_days(start: Column, end: Column, ticks: int) -> Column:
    """Completed 24-hour blocks between two instants."""
    return (end - start) if ticks == 1 else F.floor((end - start) / F.lit(ticks)).cast("bigint")


def months(days: Column) -> Column:
    return days / F.lit(DAYS_PER_MONTH)


def day_band(min_months: float, max_months: float) -> tuple[int, int]:
    """Smallest and largest whole-day gap whose month length lies in the closed band."""
    low = math.ceil(min_months * DAYS_PER_MONTH) - 1
    while low / DAYS_PER_MONTH < min_months:
        low += 1
    high = math.floor(max_months * DAYS_PER_MONTH) + 1
    while high / DAYS_PER_MONTH > max_months:
        high -= 1
    return low, high
