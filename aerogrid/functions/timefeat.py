"""Calendar and clock features.

Times have no zone (TIMESTAMP_NTZ, or TIMESTAMP under a UTC session).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from aerogrid.functions.num import col, flag, right_closed


def hour(ts="ts") -> Column:
    return F.hour(col(ts))


def day_of_week(ts="ts") -> Column:
    """Monday = 0."""
    return F.weekday(col(ts))


def is_weekend(ts="ts") -> Column:
    return flag(F.weekday(col(ts)) >= 5)


def cyclical(c, period: float) -> tuple[Column, Column]:
    """(sin, cos) of a value on a circle of the given period."""
    angle = F.lit(2.0 * math.pi) * col(c) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def encode_cyclical(df, periods: dict[str, float], drop_source: bool = True):
    """`<c>_sin` and `<c>_cos` for every column with a period; the source column goes by default."""
    made = []
    for c, period in periods.items():
        s, k = cyclical(c, period)
        made += [s.alias(f"{c}_sin"), k.alias(f"{c}_cos")]
    kept = [c for c in df.columns if not (drop_source and c in periods)]
    return df.select(*kept, *made)


def is_night(ts="ts") -> Column:
    h = F.hour(col(ts))
    return flag((h >= 22) | (h <= 6))


def is_rush_hour(ts="ts") -> Column:
    h = F.hour(col(ts))
    return flag(h.between(7, 9) | h.between(17, 19))


def season(ts="ts") -> Column:
    """Quarter-aligned seasons: Jan-Mar winter, Apr-Jun spring, Jul-Sep summer, Oct-Dec fall."""
    return right_closed(F.month(col(ts)), [0, 3, 6, 9, 12], ["winter", "spring", "summer", "fall"])


def epoch_us(ts) -> Column:
    """Microseconds since 1970 of a time."""
    return F.unix_micros(col(ts).cast("timestamp"))


def from_us(us: Column) -> Column:
    """Time from microseconds since 1970."""
    return F.timestamp_micros(us.cast("long")).cast("timestamp_ntz")


def floor_time(ts, minutes: int) -> Column:
    step = minutes * 60_000_000
    return from_us(F.floor(epoch_us(ts) / F.lit(step)) * F.lit(step))


def ceil_time(ts, minutes: int) -> Column:
    step = minutes * 60_000_000
    return from_us(F.ceil(epoch_us(ts) / F.lit(step)) * F.lit(step))


def round_time(ts, minutes: int) -> Column:
    """Nearest step; the midpoint goes to the even step (00:15 -> 00:00, 00:45 -> 01:00 for 30 minutes)."""
    step = minutes * 60_000_000
    us = epoch_us(ts)
    low = F.floor(us / F.lit(step))
    twice = (us - low * F.lit(step)) * 2
    up = (twice > F.lit(step)) | ((twice == F.lit(step)) & (low % 2 != 0))
    return from_us((low + F.when(up, 1).otherwise(0)) * F.lit(step))


def calendar_columns(ts="ts") -> list[Column]:
    """The full calendar block: clock, calendar, circles, indicators, season."""
    h_s, h_c = cyclical(F.hour(col(ts)), 24)
    d_s, d_c = cyclical(F.weekday(col(ts)), 7)
    m_s, m_c = cyclical(F.month(col(ts)), 12)
    return [
        hour(ts).alias("hour"),
        day_of_week(ts).alias("day_of_week"),
        F.day(col(ts)).alias("day_of_month"),
        F.dayofyear(col(ts)).alias("day_of_year"),
        F.weekofyear(col(ts)).alias("week_of_year"),
        F.month(col(ts)).alias("month"),
        F.quarter(col(ts)).alias("quarter"),
        h_s.alias("hour_sin"),
        h_c.alias("hour_cos"),
        d_s.alias("day_sin"),
        d_c.alias("day_cos"),
        m_s.alias("month_sin"),
        m_c.alias("month_cos"),
        is_weekend(ts).alias("is_weekend"),
        is_night(ts).alias("is_night"),
        is_rush_hour(ts).alias("is_rush_hour"),
        season(ts).alias("season"),
    ]
