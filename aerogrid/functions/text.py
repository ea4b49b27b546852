"""Decoding of report text and classification of free-text causes, all with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aerogrid.functions.num import col, flag

# Keyword lists that decide the result.
WEATHER_REASONS = ["WEATHER", "WX", "CB", "TS", "FOG", "WIND", "SNOW", "ICE", "VISIBILITY", "CEILING", "STORM"]
WIDE_REASONS = [
    "W - Weather",
    "Weather",
    "WX",
    "CB",
    "TS",
    "FOG",
    "WIND",
    "SNOW",
    "ICE",
    "T - Equipment (Terminal)",
    "I - Ind Action",
    "V - Environmental Issues",
]
CAUSE_KEYWORDS = {
    "CB": ["cb", "rain", "show", "thunderstorm"],
    "VISIBILITY/CEILING": ["visibility", "ceiling", "vis", "lvp", "l.v.p."],
    "WIND": ["wind"],
    "FOG": ["fog"],
    "SNOW/ICE": ["snow", "freez", "icing", "ice"],
}
PHENOMENA = {
    "has_fog": ["FG", "BR"],
    "has_rain": ["RA", "DZ"],
    "has_snow": ["SN", "SG"],
    "has_thunderstorm": ["TS"],
    "has_ice": ["FZ", "IC"],
}
COVER_CODES = {"FEW": 1, "SCT": 2, "BKN": 3, "OVC": 4}

# Layout of the report groups, and what a unit is in knots, metres or hectopascals.
WIND_GROUP = r"\b(VRB|[0-9]{3})P?([0-9]{2,3})(?:GP?([0-9]{2,3}))?(KT|MPS|KMH)\b"
VISIBILITY_GROUP = r"(?:KT|MPS|KMH)(?: [0-9]{3}V[0-9]{3})? ([0-9]{4})(?:NDV)?\b"
MILES_GROUP = r"(?:^|\s)[PM]?(?:([0-9]{1,2}) )?([0-9]{1,2})(?:/([0-9]{1,2}))?SM\b"
CLEAR_GROUP = r"\bCAVOK\b"
CLOUD_GROUP = r"\b(?:FEW|SCT|BKN|OVC)[0-9]{3}"
VERTICAL_GROUP = r"\bVV([0-9]{3})\b"
TEMPERATURE_GROUP = r"\b(M?[0-9]{2})/(M?[0-9]{2}\b|//|(?=\s|$))"
PRESSURE_GROUP = r"\bQ([0-9]{4})\b"
INCHES_GROUP = r"\bA([0-9]{4})\b"
LATER_GROUPS = r"\s(?:RMK|TEMPO|BECMG|NOSIG|PROB[0-9]{2}|FM[0-9]{6})\b"
KNOTS = {"KT": 1.0, "MPS": 1.9438444924, "KMH": 0.5399568035}
METRES_A_MILE = 1609.344
HECTOPASCALS = 0.338638866667  # of a hundredth of an inch
CLEAR_VISIBILITY = 10000.0
VALIDITY_GROUP = r"\b([0-9]{2})([0-9]{2})/([0-9]{2})([0-9]{2})\b"


def _any_of(text: Column, words: list[str]) -> Column:
    cond = None
    for word in words:
        hit = text.contains(word)
        cond = hit if cond is None else cond | hit
    return cond


def is_weather_reason(reason) -> Column:
    """True when the upper-cased reason contains a weather keyword; missing is false."""
    return F.coalesce(_any_of(F.upper(col(reason)), WEATHER_REASONS), F.lit(False))


def is_wide_reason(reason) -> Column:
    """Case-insensitive match of the wide list.  Entries are patterns, so their brackets only group."""
    return F.coalesce(col(reason).rlike("(?i)" + "|".join(WIDE_REASONS)), F.lit(False))


def cause_class(description) -> Column:
    """First matching cause class of a free text, OTHER when none matches or the text is missing."""
    text = F.lower(col(description))
    out = None
    for name, words in CAUSE_KEYWORDS.items():
        cond = _any_of(text, words)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise("OTHER")


def phenomenon_flags(report) -> list[Column]:
    return [flag(_any_of(col(report), codes)).alias(name) for name, codes in PHENOMENA.items()]


def _number(text: Column) -> Column:
    """Number from a group text; a group that is absent (empty) is null."""
    return F.when(F.length(text) > 0, text).cast("double")


def _degrees(text: Column) -> Column:
    """'M05' is -5."""
    magnitude = _number(F.regexp_replace(text, "M", ""))
    return F.when(text.startswith("M"), -magnitude).otherwise(magnitude)


def wind_direction_text(report) -> Column:
    """Direction as text: three digits, VRB, or null without a wind group."""
    found = F.regexp_extract(col(report), WIND_GROUP, 1)
    return F.when(F.length(found) > 0, found)


def cloud_layers(report) -> Column:
    """Array of (cover text, height in feet), in report order."""
    groups = F.regexp_extract_all(col(report), F.lit(CLOUD_GROUP), F.lit(0))
    return F.transform(
        groups,
        lambda g: F.struct(
            F.substring(g, 1, 3).alias("cover"), (F.substring(g, 4, 3).cast("double") * 100.0).alias("height_ft")
        ),
    )


def _knots(body: Column, group: int) -> Column:
    """Wind group number in knots; a group without numbers (`/////KT`) is null."""
    unit, value = F.regexp_extract(body, WIND_GROUP, 4), _number(F.regexp_extract(body, WIND_GROUP, group))
    out = F.when(unit == "KT", value)
    for name, factor in list(KNOTS.items())[1:]:
        out = out.when(unit == name, value * F.lit(factor))
    return out


def _metres(body: Column) -> Column:
    """Visibility: the four digits after the wind, or miles with a fraction, or what CAVOK stands for."""
    whole, top, under = (_number(F.regexp_extract(body, MILES_GROUP, i)) for i in (1, 2, 3))
    miles = F.coalesce(whole, F.lit(0.0)) + F.when(under.isNull(), top).otherwise(top / under)
    clear = F.when(body.rlike(CLEAR_GROUP), F.lit(CLEAR_VISIBILITY))
    return F.coalesce(clear, _number(F.regexp_extract(body, VISIBILITY_GROUP, 1)), miles * F.lit(METRES_A_MILE))


def decode_report(report) -> list[Column]:
    """Wind, visibility, lowest broken/overcast layer, temperatures and pressure of one report.

    Only the groups before remarks and change groups count.  Winds in metres per second or kilometres per hour, miles, CAVOK, vertical
    visibility and pressure in inches are turned into knots, metres, feet and hectopascals; groups of slashes are null.
    """
    c = F.split(col(report), LATER_GROUPS, 2)[0]
    ceilings = F.transform(
        F.filter(cloud_layers(c), lambda x: x["cover"].isin("BKN", "OVC")), lambda x: x["height_ft"]
    )
    vertical = _number(F.regexp_extract(c, VERTICAL_GROUP, 1)) * 100.0
    inches = _number(F.regexp_extract(c, INCHES_GROUP, 1)) * F.lit(HECTOPASCALS)
    return [
        F.regexp_extract(c, WIND_GROUP, 1).try_cast("double").alias("wind_direction"),
        _knots(c, 2).alias("wind_speed_kt"),
        _knots(c, 3).alias("wind_gust_kt"),
        _metres(c).alias("visibility_m"),
        F.least(F.array_min(ceilings), vertical).alias("ceiling_ft"),
        _degrees(F.regexp_extract(c, TEMPERATURE_GROUP, 1)).alias("temperature_c"),
        _degrees(F.regexp_replace(F.regexp_extract(c, TEMPERATURE_GROUP, 2), "/", "")).alias("dewpoint_c"),
        F.coalesce(_number(F.regexp_extract(c, PRESSURE_GROUP, 1)), inches).alias("pressure_hpa"),
    ]


def legacy_fields(report) -> list[Column]:
    """Archive decode of one report; temperatures stay null here and are taken from the previous row later."""
    c = col(report)
    layers = cloud_layers(c)
    last = F.try_element_at(layers, F.lit(-1))
    code = None
    for name, number in COVER_CODES.items():
        code = F.when(last["cover"] == name, number) if code is None else code.when(last["cover"] == name, number)
    vis = _number(F.regexp_extract(c, VISIBILITY_GROUP, 1))
    return [
        F.when(vis.isNull() | (vis == 9999), 10000.0).otherwise(vis).alias("visibility_m"),
        F.coalesce(code, F.lit(0)).alias("ceiling_cover"),
        F.coalesce(last["height_ft"], F.lit(5000.0)).alias("ceiling_ft"),
        F.coalesce(_number(F.regexp_extract(c, WIND_GROUP, 2)), F.lit(0.0)).alias("wind_speed_kt"),
        F.coalesce(wind_direction_text(c), F.lit("No info")).alias("wind_direction_text"),
        _degrees(F.regexp_extract(c, TEMPERATURE_GROUP, 1)).alias("temperature_c"),
        _degrees(F.regexp_extract(c, TEMPERATURE_GROUP, 2)).alias("dewpoint_c"),
    ]


def forecast_wind_max(report) -> list[Column]:
    """Largest wind and gust over all wind groups of one forecast report."""
    c = col(report)
    speeds = F.regexp_extract_all(c, F.lit(WIND_GROUP), F.lit(2))
    gusts = F.regexp_extract_all(c, F.lit(WIND_GROUP), F.lit(3))
    return [
        F.array_max(F.transform(speeds, _number)).alias("max_wind_kt"),
        F.array_max(F.transform(gusts, _number)).alias("max_gust_kt"),
    ]
