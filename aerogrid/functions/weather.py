"""Weather formulas, categories and scores as column expressions.

Two definitions exist for humidity, wind chill, severity and flight category.  They differ on purpose
and stay separate: the `grid_` ones belong to the grid features, the `report_` ones to the weather block.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aerogrid.functions.num import clip, col, flag, right_closed

INF = float("inf")


def _magnus(t: Column, a: float, b: float) -> Column:
    return F.try_divide(F.lit(a) * t, F.lit(b) + t)


def grid_humidity(temp, dew) -> Column:
    """Relative humidity in percent (Magnus 17.27 / 237.7), clipped to 0..100."""
    t, d = col(temp), col(dew)
    return clip(100.0 * F.exp(_magnus(d, 17.27, 237.7) - _magnus(t, 17.27, 237.7)), 0.0, 100.0)


def report_humidity(temp, dew) -> Column:
    """Relative humidity in percent (Magnus 17.625 / 243.04), not clipped."""
    t, d = col(temp), col(dew)
    return 100.0 * F.exp(_magnus(d, 17.625, 243.04)) / F.exp(_magnus(t, 17.625, 243.04))


def _chill(t: Column, kmh: Column) -> Column:
    power = F.pow(kmh, F.lit(0.16))
    return F.lit(13.12) + F.lit(0.6215) * t - F.lit(11.37) * power + F.lit(0.3965) * t * power


def grid_wind_chill(temp, knots) -> Column:
    """Wind chill from knots where it is at most 10 degrees and at least 4.8 km/h, else the temperature."""
    t, kmh = col(temp), col(knots) * F.lit(1.852)
    return F.when((t <= 10.0) & (kmh >= 4.8), _chill(t, kmh)).otherwise(t)


def report_wind_chill(temp, speed) -> Column:
    """Wind chill with the speed as given and strict limits, else the temperature."""
    t, v = col(temp), col(speed)
    return F.when((t < 10.0) & (v > 4.8), _chill(t, v)).otherwise(t)


def gust_factor(gust, speed) -> Column:
    return F.try_divide(col(gust), col(speed) + 1.0)


def turbulence(gust, speed) -> Column:
    return flag(gust_factor(gust, speed) > 1.5)


def runway_angle(direction, bearing: float) -> Column:
    """Angle between the wind and a runway bearing, folded to at most 180 degrees."""
    d = F.abs(col(direction) - F.lit(float(bearing)))
    return F.when(d.isNotNull(), F.least(d, 360.0 - d))


def crosswind(direction, speed, bearing: float) -> Column:
    return col(speed) * F.sin(F.radians(runway_angle(direction, bearing)))


def headwind(direction, speed, bearing: float) -> Column:
    return col(speed) * F.cos(F.radians(runway_angle(direction, bearing)))


def grid_severity(fog, thunder, ice, visibility, ceiling) -> Column:
    """Flags and low values weighted: fog 2, thunder 3, ice 3, visibility < 1000 2, ceiling < 500 2."""
    return (
        col(fog) * 2
        + col(thunder) * 3
        + col(ice) * 3
        + flag(col(visibility) < 1000) * 2
        + flag(col(ceiling) < 500) * 2
    )


def report_severity(visibility, ceiling, wind) -> Column:
    """Sum of graded limits on visibility, ceiling and wind."""
    v, c, w = col(visibility), col(ceiling), col(wind)
    return (
        flag(v < 1000) * 3
        + flag(v < 3000) * 2
        + flag(c < 200) * 3
        + flag(c < 500) * 2
        + flag(w > 25) * 2
        + flag(w > 35) * 3
    )


def flight_category(ceiling, visibility) -> Column:
    """LIFR / IFR / MVFR / VFR, and unknown when either value is missing."""
    c, v = col(ceiling), col(visibility)
    return (
        F.when(c.isNull() | v.isNull(), "unknown")
        .when((c < 200) | (v < 550), "LIFR")
        .when((c < 500) | (v < 1600), "IFR")
        .when((c < 1000) | (v < 5000), "MVFR")
        .otherwise("VFR")
    )


def flight_category_code(visibility, ceiling) -> Column:
    """4 (best) to 1; a missing value fails every test and gives 1."""
    v, c = col(visibility), col(ceiling)
    return (
        F.when((v >= 5000) & (c >= 3000), 4)
        .when((v >= 3000) & (c >= 1000), 3)
        .when((v >= 1600) & (c >= 500), 2)
        .otherwise(1)
    )


def condition_flags(visibility, ceiling, wind, temp, dew) -> list[Column]:
    """0/1 flags for low visibility, low ceiling, strong wind and fog risk, with the derived products."""
    v, c, w, t = col(visibility), col(ceiling), col(wind), col(temp)
    spread = t - col(dew)
    return [
        flag(v < 5000).alias("low_visibility"),
        flag(v < 1000).alias("very_low_visibility"),
        flag(c < 1000).alias("low_ceiling"),
        flag(c < 500).alias("very_low_ceiling"),
        flag(w > 15).alias("high_wind"),
        flag(w > 25).alias("very_high_wind"),
        spread.alias("temp_dewpoint_diff"),
        flag((spread < 3) & (v < 5000)).alias("fog_risk"),
        (w * t).alias("wind_temp_interaction"),
    ]


def visibility_category(c) -> Column:
    return right_closed(
        c, [0, 1000, 3000, 5000, 10000, INF], ["very_poor", "poor", "moderate", "good", "excellent"]
    )


def ceiling_category(c) -> Column:
    return right_closed(c, [0, 200, 500, 1000, 3000, INF], ["very_low", "low", "moderate", "high", "unlimited"])


def wind_quadrant(direction) -> Column:
    """(0,90] 1, (90,180] 2, (180,270] 3, (270,359] 4; 0 and 360 are null."""
    return right_closed(direction, [0, 90, 180, 270, 359], [1, 2, 3, 4])
