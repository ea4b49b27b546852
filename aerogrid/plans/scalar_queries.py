"""Filters, projections, calendar, weather and text functions on the observation views."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerogrid.functions import text as T
from aerogrid.functions import timefeat as D
from aerogrid.functions import weather as M
from aerogrid.functions.num import clip, ratio, rnd
from aerogrid.operators import filters, intervals, ordering, prep
from aerogrid.plans.oracle_views import r
from aerogrid.plans.registry import query
from aerogrid.session import settle
from aerogrid.sources import standins as S

# ---------------------------------------------------------------- filters and projections


@query("filter_equal", "F-01", "SELECT event_id, ts, station FROM obs WHERE station = 'EGLL'")
def _(spark, d):
    return filters.filter_equal(S.observations(spark, d), "station", "EGLL").select("event_id", "ts", "station")


@query(
    "filter_date_range",
    "F-02",
    """SELECT event_id, ts, station, temperature_c FROM obs
WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'""",
)
def _(spark, d):
    obs = S.observations(spark, d)
    return filters.filter_dates(obs, "ts", "2024-01-10 00:00:00", "2024-01-20 00:00:00").select(
        "event_id", "ts", "station", "temperature_c"
    )


@query(
    "usable_intervals",
    "F-03",
    """SELECT station, start_time, end_time, duration_min, ordinal FROM intervals
WHERE location_type = 'Aerodrome' AND NOT cancelled AND duration_min >= 30""",
)
def _(spark, d):
    return filters.usable_intervals(S.intervals(spark, d)).select(
        "station", "start_time", "end_time", "duration_min", "ordinal"
    )


@query(
    "weather_intervals_at_station",
    "F-04",
    """SELECT ordinal, start_time, end_time, reason FROM intervals
WHERE reason = 'W - Weather' AND location_type = 'Aerodrome' AND station = 'LSZH'""",
)
def _(spark, d):
    return filters.weather_at_station(S.intervals(spark, d), "LSZH").select(
        "ordinal", "start_time", "end_time", "reason"
    )


@query(
    "weather_reason_flag",
    "F-05",
    """SELECT ordinal, reason, coalesce(regexp_matches(upper(reason),
 'WEATHER|WX|CB|TS|FOG|WIND|SNOW|ICE|VISIBILITY|CEILING|STORM'), false) AS is_weather_related FROM intervals""",
)
def _(spark, d):
    return filters.with_weather_flag(S.intervals(spark, d)).select("ordinal", "reason", "is_weather_related")


@query(
    "wide_reason_match",
    "F-06",
    """SELECT ordinal, reason, description, coalesce(regexp_matches(reason,
'(?i)W - Weather|Weather|WX|CB|TS|FOG|WIND|SNOW|ICE|T - Equipment (Terminal)|I - Ind Action|V - Environmental Issues'),
 false) AS is_wide FROM intervals""",
)
def _(spark, d):
    return S.intervals(spark, d).select(
        "ordinal", "reason", "description", T.is_wide_reason("reason").alias("is_wide")
    )


@query(
    "project_numeric_columns",
    "F-07",
    """SELECT event_id, temperature_c, dewpoint_c, wind_speed_kt, wind_direction, wind_gust_kt, visibility_m, ceiling_ft,
 pressure_hpa FROM obs""",
)
def _(spark, d):
    return filters.project_kind(S.observations(spark, d), "numeric")


@query("project_categorical_columns", "F-07", "SELECT model, experiment, error FROM trials")
def _(spark, d):
    return filters.project_kind(S.trials(spark, d), "categorical")


@query(
    "drop_incomplete_after_lag",
    "F-08",
    """SELECT * FROM (SELECT event_id, station, temperature_c,
 lag(temperature_c, 1) OVER w AS temperature_c_lag_1, lag(temperature_c, 3) OVER w AS temperature_c_lag_3
 FROM obs WINDOW w AS (PARTITION BY station ORDER BY ts, event_id))
WHERE temperature_c_lag_1 IS NOT NULL AND temperature_c_lag_3 IS NOT NULL AND temperature_c IS NOT NULL""",
)
def _(spark, d):
    c = F.col("temperature_c")
    lagged = ordering.over_series(
        S.observations(spark, d),
        lambda w: [F.lag(c, k).over(w).alias(f"temperature_c_lag_{k}") for k in (1, 3)],
        back=3,
        keep=["event_id", "station", "temperature_c"],
    )
    return lagged.dropna()


@query(
    "drop_sparse_columns",
    "F-09",
    "SELECT event_id, temperature_c, visibility_m, ceiling_ft FROM obs",
)
def _(spark, d):
    obs = S.observations(spark, d).select("event_id", "temperature_c", "visibility_m", "ceiling_ft", "wind_gust_kt")
    return filters.drop_sparse_columns(obs, 0.5)


_BASE = ["event_id", "station", "visibility_m", "ceiling_ft", "wind_speed_kt"]


@query(
    "final_column_list",
    "F-10",
    f"""PIVOT (SELECT {", ".join(_BASE)}, {r("coalesce(time_to_regulation, 999)")} AS hours_to_regulation,
 CAST(coalesce(time_to_regulation, 999) BETWEEN 0 AND 2 AS INTEGER) AS regulation_imminent, 'station_' || substr(station, 4, 1) AS s FROM windowed)
ON s USING CAST(count(*) AS INTEGER) GROUP BY {", ".join(_BASE)}, hours_to_regulation, regulation_imminent""",
)
def _(spark, d):
    """Base columns, the imminence columns, and an indicator for every group of stations that there is."""
    windows = intervals.sampling_windows(filters.usable_intervals(S.intervals(spark, d)))
    rows = settle(intervals.imminence(intervals.label_with_windows(S.observations(spark, d), windows), 999.0).withColumn("_g", F.substring("station", 4, 1)))
    flagged = prep.one_hot(rows, "_g", "station")
    out = filters.final_columns(flagged, _BASE, ["hours_to_regulation", "regulation_imminent"], ["station_"])
    return out.withColumn("hours_to_regulation", rnd("hours_to_regulation") + F.lit(0.0))


# ---------------------------------------------------------------- date and time

_D03 = ", ".join(
    f"{r(f'{fn}(2 * pi() * {e} / {p})')} AS {n}_{fn}"
    for n, e, p in [("hour", "hour(ts)", 24), ("day", "(isodow(ts) - 1)", 7), ("month", "month(ts)", 12)]
    for fn in ("sin", "cos")
)


@query(
    "clock_features",
    "D-01",
    """SELECT event_id, hour(ts) AS "hour", isodow(ts) - 1 AS day_of_week, month(ts) AS "month",
 CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend FROM obs""",
)
def _(spark, d):
    return S.observations(spark, d).select(
        "event_id",
        D.hour().alias("hour"),
        D.day_of_week().alias("day_of_week"),
        F.month("ts").alias("month"),
        D.is_weekend().alias("is_weekend"),
    )


@query(
    "calendar_features",
    "D-02",
    """SELECT event_id, day(ts) AS day_of_month, dayofyear(ts) AS day_of_year, week(ts) AS week_of_year,
 quarter(ts) AS "quarter" FROM obs""",
)
def _(spark, d):
    return S.observations(spark, d).select(
        "event_id",
        F.day("ts").alias("day_of_month"),
        F.dayofyear("ts").alias("day_of_year"),
        F.weekofyear("ts").alias("week_of_year"),
        F.quarter("ts").alias("quarter"),
    )


@query("cyclical_time_features", "D-03", f"SELECT event_id, {_D03} FROM obs")
def _(spark, d):
    base = S.observations(spark, d).select(
        "event_id", D.hour().alias("hour"), D.day_of_week().alias("day"), F.month("ts").alias("month")
    )
    out = D.encode_cyclical(base, {"hour": 24, "day": 7, "month": 12})
    return out.select("event_id", *[(rnd(c) + F.lit(0.0)).alias(c) for c in out.columns if c != "event_id"])


@query(
    "night_and_rush_hour",
    "D-04",
    """SELECT event_id, CAST(hour(ts) >= 22 OR hour(ts) <= 6 AS INTEGER) AS is_night,
 CAST(hour(ts) BETWEEN 7 AND 9 OR hour(ts) BETWEEN 17 AND 19 AS INTEGER) AS is_rush_hour FROM obs""",
)
def _(spark, d):
    return S.observations(spark, d).select(
        "event_id", D.is_night().alias("is_night"), D.is_rush_hour().alias("is_rush_hour")
    )


@query(
    "season",
    "D-05",
    """SELECT o_orderkey, CASE quarter(o_orderdate) WHEN 1 THEN 'winter' WHEN 2 THEN 'spring' WHEN 3 THEN 'summer'
 ELSE 'fall' END AS season FROM orders""",
)
def _(spark, d):
    return S.table(spark, d, "orders").select("o_orderkey", D.season("o_orderdate").alias("season"))


@query(
    "step_rounding",
    "D-06",
    """SELECT event_id, floor_30, ceil_30, CASE
   WHEN 2 * (us - lo) > 1800000000 OR (2 * (us - lo) = 1800000000 AND (lo // 1800000000) % 2 = 1)
   THEN floor_30 + INTERVAL 30 MINUTE ELSE floor_30 END AS round_30
FROM (SELECT event_id, epoch_us(m) AS us, epoch_us(m) - epoch_us(m) % 1800000000 AS lo,
  time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '2000-01-01') AS floor_30,
  time_bucket(INTERVAL 30 MINUTE, ts + INTERVAL 30 MINUTE - INTERVAL 1 MICROSECOND, TIMESTAMP '2000-01-01') AS ceil_30
  FROM (SELECT *, date_trunc('minute', ts) AS m FROM obs))""",
)
def _(spark, d):
    return S.observations(spark, d).select(
        "event_id",
        D.floor_time("ts", 30).alias("floor_30"),
        D.ceil_time("ts", 30).alias("ceil_30"),
        D.round_time(D.floor_time("ts", 1), 30).alias("round_30"),
    )


@query(
    "temporal_completeness",
    "D-07",
    f"""SELECT station, count(*) AS n,
 {r("count(*) / (CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / 1800000000)")} AS completeness
FROM obs GROUP BY station""",
)
def _(spark, d):
    span = (D.epoch_us(F.max("ts")) - D.epoch_us(F.min("ts"))).cast("double") / F.lit(1_800_000_000.0)
    return (
        S.observations(spark, d)
        .groupBy("station")
        .agg(F.count(F.lit(1)).alias("n"), rnd(F.try_divide(F.count(F.lit(1)).cast("double"), span)).alias("completeness"))
    )


# ---------------------------------------------------------------- weather formulas


def _both(name, ids, sql_cols, cols):
    """A projection of the observations: key plus computed columns."""

    @query(name, ids, f"SELECT event_id, {sql_cols} FROM obs")
    def _(spark, d):
        return S.observations(spark, d).select("event_id", *cols())


_both(
    "humidity_grid",
    "M-01",
    f"""CASE WHEN temperature_c IS NOT NULL AND dewpoint_c IS NOT NULL THEN
 {r("greatest(0, least(100, 100 * exp(17.27::DOUBLE * dewpoint_c / (237.7::DOUBLE + dewpoint_c) - 17.27::DOUBLE * temperature_c / (237.7::DOUBLE + temperature_c))))")} END AS relative_humidity""",
    lambda: [rnd(M.grid_humidity("temperature_c", "dewpoint_c")).alias("relative_humidity")],
)
_both(
    "humidity_report",
    "M-02",
    r(
        "100 * exp(17.625::DOUBLE * dewpoint_c / (243.04::DOUBLE + dewpoint_c)) / exp(17.625::DOUBLE * temperature_c / (243.04::DOUBLE + temperature_c))"
    )
    + " AS relative_humidity",
    lambda: [rnd(M.report_humidity("temperature_c", "dewpoint_c")).alias("relative_humidity")],
)


def _chill_sql(t, v, cond):
    power = f"pow({v}, 0.16::DOUBLE)"
    body = f"13.12::DOUBLE + 0.6215::DOUBLE * {t} - 11.37::DOUBLE * {power} + 0.3965::DOUBLE * {t} * {power}"
    return f"CASE WHEN {cond} THEN {body} ELSE {t} END"


_both(
    "wind_chill_grid",
    "M-03",
    r(
        _chill_sql(
            "temperature_c",
            "(wind_speed_kt * 1.852::DOUBLE)",
            "temperature_c <= 10 AND wind_speed_kt * 1.852::DOUBLE >= 4.8::DOUBLE",
        )
    )
    + " AS wind_chill",
    lambda: [(rnd(M.grid_wind_chill("temperature_c", "wind_speed_kt")) + F.lit(0.0)).alias("wind_chill")],
)
_both(
    "wind_chill_report",
    "M-04",
    r(_chill_sql("temperature_c", "wind_speed_kt", "temperature_c < 10 AND wind_speed_kt > 4.8::DOUBLE"))
    + " AS wind_chill",
    lambda: [(rnd(M.report_wind_chill("temperature_c", "wind_speed_kt")) + F.lit(0.0)).alias("wind_chill")],
)
_both(
    "weather_products",
    "M-05",
    f"""{r("temperature_c - dewpoint_c")} AS temp_dewpoint_spread, {r("ceiling_ft * visibility_m")} AS ceiling_visibility_product,
 {r("wind_speed_kt * temperature_c")} AS wind_temp_interaction""",
    lambda: [
        rnd(F.col("temperature_c") - F.col("dewpoint_c")).alias("temp_dewpoint_spread"),
        rnd(F.col("ceiling_ft") * F.col("visibility_m")).alias("ceiling_visibility_product"),
        (rnd(F.col("wind_speed_kt") * F.col("temperature_c")) + F.lit(0.0)).alias("wind_temp_interaction"),
    ],
)
_both(
    "gust_factor",
    "M-06",
    f"""{r("wind_gust_kt / (wind_speed_kt + 1)")} AS gust_factor,
 CAST(coalesce(wind_gust_kt / (wind_speed_kt + 1) > 1.5::DOUBLE, false) AS INTEGER) AS turbulence""",
    lambda: [
        rnd(M.gust_factor("wind_gust_kt", "wind_speed_kt")).alias("gust_factor"),
        M.turbulence("wind_gust_kt", "wind_speed_kt").alias("turbulence"),
    ],
)


def _angle_sql(b):
    return f"least(abs(wind_direction - {b}), 360 - abs(wind_direction - {b}))"


_both(
    "runway_wind_components",
    "M-07",
    ", ".join(
        f"{r(f'wind_speed_kt * {fn}(radians({_angle_sql(b)}))')} AS {n}_rwy_{b}"
        for b in (90, 270)
        for n, fn in (("crosswind", "sin"), ("headwind", "cos"))
    ),
    lambda: [
        (rnd(f("wind_direction", "wind_speed_kt", b)) + F.lit(0.0)).alias(f"{n}_rwy_{b}")
        for b in (90, 270)
        for n, f in (("crosswind", M.crosswind), ("headwind", M.headwind))
    ],
)


@query(
    "severity_grid",
    "M-08",
    """SELECT event_id, CAST(contains(report, 'FG') OR contains(report, 'BR') AS INTEGER) * 2
 + CAST(contains(report, 'TS') AS INTEGER) * 3 + CAST(contains(report, 'FZ') OR contains(report, 'IC') AS INTEGER) * 3
 + CAST(visibility_m < 1000 AS INTEGER) * 2 + CAST(coalesce(ceiling_ft < 500, false) AS INTEGER) * 2 AS weather_severity
FROM raw_report JOIN obs USING (event_id)""",
)
def _(spark, d):
    reports = S.raw_reports(spark, d).select("event_id", *T.phenomenon_flags("report"))
    obs = S.observations(spark, d).select("event_id", "visibility_m", "ceiling_ft")
    score = M.grid_severity("has_fog", "has_thunderstorm", "has_ice", "visibility_m", "ceiling_ft")
    return reports.join(obs, "event_id").select("event_id", score.alias("weather_severity"))


_both(
    "severity_report",
    "M-09",
    """CAST(visibility_m < 1000 AS INTEGER) * 3 + CAST(visibility_m < 3000 AS INTEGER) * 2
 + CAST(coalesce(ceiling_ft < 200, false) AS INTEGER) * 3 + CAST(coalesce(ceiling_ft < 500, false) AS INTEGER) * 2
 + CAST(wind_speed_kt > 25 AS INTEGER) * 2 + CAST(wind_speed_kt > 35 AS INTEGER) * 3 AS weather_severity""",
    lambda: [M.report_severity("visibility_m", "ceiling_ft", "wind_speed_kt").alias("weather_severity")],
)
_both(
    "flight_category_text",
    "M-10",
    """CASE WHEN ceiling_ft IS NULL OR visibility_m IS NULL THEN 'unknown' WHEN ceiling_ft < 200 OR visibility_m < 550 THEN 'LIFR'
 WHEN ceiling_ft < 500 OR visibility_m < 1600 THEN 'IFR' WHEN ceiling_ft < 1000 OR visibility_m < 5000 THEN 'MVFR'
 ELSE 'VFR' END AS flight_category""",
    lambda: [M.flight_category("ceiling_ft", "visibility_m").alias("flight_category")],
)
_both(
    "flight_category_code",
    "M-11",
    """CASE WHEN visibility_m >= 5000 AND ceiling_ft >= 3000 THEN 4 WHEN visibility_m >= 3000 AND ceiling_ft >= 1000 THEN 3
 WHEN visibility_m >= 1600 AND ceiling_ft >= 500 THEN 2 ELSE 1 END AS flight_category""",
    lambda: [M.flight_category_code("visibility_m", "ceiling_ft").alias("flight_category")],
)


@query(
    "variable_wind",
    "M-12",
    r"""WITH t AS (SELECT event_id, nullif(regexp_extract(report, '\b(VRB|[0-9]{3})([0-9]{2,3})(G([0-9]{2,3}))?KT\b', 1), '') AS wd
 FROM raw_report), n AS (SELECT *, TRY_CAST(wd AS DOUBLE) AS x FROM t)
SELECT event_id, CAST(coalesce(wd = 'VRB', false) AS INTEGER) AS variable_wind,
 coalesce(x, (SELECT median(x) FROM n)) AS wind_direction FROM n""",
)
def _(spark, d):
    reports = S.raw_reports(spark, d).select("event_id", T.wind_direction_text("report").alias("wind_direction"))
    return prep.clean_wind_direction(reports, "wind_direction")


_both(
    "condition_flags",
    "M-13",
    f"""CAST(visibility_m < 5000 AS INTEGER) AS low_visibility, CAST(visibility_m < 1000 AS INTEGER) AS very_low_visibility,
 CAST(coalesce(ceiling_ft < 1000, false) AS INTEGER) AS low_ceiling, CAST(coalesce(ceiling_ft < 500, false) AS INTEGER) AS very_low_ceiling,
 CAST(wind_speed_kt > 15 AS INTEGER) AS high_wind, CAST(wind_speed_kt > 25 AS INTEGER) AS very_high_wind,
 {r("temperature_c - dewpoint_c", 4)} AS temp_dewpoint_diff,
 CAST(temperature_c - dewpoint_c < 3 AND visibility_m < 5000 AS INTEGER) AS fog_risk,
 {r("wind_speed_kt * temperature_c", 4)} AS wind_temp_interaction""",
    lambda: [
        (rnd(c, 4) + F.lit(0.0)).alias(n) if n in ("temp_dewpoint_diff", "wind_temp_interaction") else c
        for n, c in zip(
            [
                "low_visibility",
                "very_low_visibility",
                "low_ceiling",
                "very_low_ceiling",
                "high_wind",
                "very_high_wind",
                "temp_dewpoint_diff",
                "fog_risk",
                "wind_temp_interaction",
            ],
            M.condition_flags("visibility_m", "ceiling_ft", "wind_speed_kt", "temperature_c", "dewpoint_c"),
        )
    ],
)
_both(
    "power_and_log",
    "M-15",
    ", ".join(
        f"{r(f'{c} * {c}', 4)} AS {c}_pow_2, {r(f'sqrt(abs({c}))')} AS {c}_sqrt, {r(f'ln(1 + abs({c}))')} AS {c}_log"
        for c in ("temperature_c", "pressure_hpa", "wind_speed_kt")
    ),
    lambda: [
        e
        for c in ("temperature_c", "pressure_hpa", "wind_speed_kt")
        for e in (
            rnd(F.pow(F.col(c), F.lit(2.0)), 4).alias(f"{c}_pow_2"),
            rnd(F.sqrt(F.abs(F.col(c)))).alias(f"{c}_sqrt"),
            rnd(F.log1p(F.abs(F.col(c)))).alias(f"{c}_log"),
        )
    ],
)


@query(
    "zero_guarded_rates",
    "M-16",
    f"""WITH c AS (SELECT model, count(*) FILTER (y = 1 AND score >= 0.9) AS tp, count(*) FILTER (y = 0 AND score >= 0.9) AS fp,
  count(*) FILTER (y = 1 AND score < 0.9) AS fn FROM scored GROUP BY model),
 p AS (SELECT model, CASE WHEN tp + fp = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision_,
  CASE WHEN tp + fn = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS recall_ FROM c)
SELECT model, {r("precision_")} AS "precision", {r("recall_")} AS recall,
 {r("CASE WHEN precision_ + recall_ = 0 THEN 0 ELSE 2 * precision_ * recall_ / (precision_ + recall_) END")} AS f1 FROM p""",
)
def _(spark, d):
    hit = F.col("score") >= 0.9
    counts = (
        S.scored(spark, d)
        .groupBy("model")
        .agg(
            F.count_if(hit & (F.col("y") == 1)).alias("tp"),
            F.count_if(hit & (F.col("y") == 0)).alias("fp"),
            F.count_if(~hit & (F.col("y") == 1)).alias("fn"),
        )
    )
    p, rec = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select(
        "model", rnd(p).alias("precision"), rnd(rec).alias("recall"), rnd(ratio(2 * p * rec, p + rec)).alias("f1")
    )


@query(
    "forecast_percentage_error",
    "M-17",
    f"""SELECT l_orderkey, l_linenumber, l_quantity, l_discount,
 {r("CASE WHEN l_discount <> 0 THEN abs(l_discount - l_tax) / l_discount * 100 ELSE 0 END", 4)} AS error_pct FROM features""",
)
def _(spark, d):
    y, e = F.col("l_discount"), F.abs(F.col("l_discount") - F.col("l_tax"))
    error = F.when(y != 0, e / y * 100.0).otherwise(0.0)
    return S.features(spark, d).select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", rnd(error, 4).alias("error_pct")
    )


# ---------------------------------------------------------------- bins and text

_both(
    "visibility_category",
    "T-01",
    """CASE WHEN visibility_m <= 0 THEN NULL WHEN visibility_m <= 1000 THEN 'very_poor' WHEN visibility_m <= 3000 THEN 'poor'
 WHEN visibility_m <= 5000 THEN 'moderate' WHEN visibility_m <= 10000 THEN 'good' WHEN visibility_m > 10000 THEN 'excellent' END
 AS vis_category""",
    lambda: [M.visibility_category("visibility_m").alias("vis_category")],
)
_both(
    "ceiling_category",
    "T-02",
    """CASE WHEN ceiling_ft <= 0 THEN NULL WHEN ceiling_ft <= 200 THEN 'very_low' WHEN ceiling_ft <= 500 THEN 'low'
 WHEN ceiling_ft <= 1000 THEN 'moderate' WHEN ceiling_ft <= 3000 THEN 'high' WHEN ceiling_ft > 3000 THEN 'unlimited' END
 AS ceiling_category""",
    lambda: [M.ceiling_category("ceiling_ft").alias("ceiling_category")],
)


@query(
    "wind_quadrant_indicators",
    "T-03",
    r"""WITH t AS (SELECT event_id, coalesce(nullif(regexp_extract(report,
   '\b(VRB|[0-9]{3})([0-9]{2,3})(G([0-9]{2,3}))?KT\b', 1), ''), 'No info') AS wd FROM raw_report),
 top AS (SELECT TRY_CAST(wd AS DOUBLE) AS x FROM t WHERE TRY_CAST(wd AS DOUBLE) IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
 q AS (SELECT event_id, coalesce(TRY_CAST(wd AS DOUBLE), (SELECT x FROM top)) AS v FROM t)
SELECT event_id, CAST(v > 0 AND v <= 90 AS INTEGER) AS wind_1, CAST(v > 90 AND v <= 180 AS INTEGER) AS wind_2,
 CAST(v > 180 AND v <= 270 AS INTEGER) AS wind_3, CAST(v > 270 AND v <= 359 AS INTEGER) AS wind_4 FROM q""",
)
def _(spark, d):
    text = F.coalesce(T.wind_direction_text("report"), F.lit("No info"))
    reports = S.raw_reports(spark, d).select("event_id", text.alias("wind"))
    return prep.wind_quadrants(reports, "wind", "wind").select("event_id", *[f"wind_{i}" for i in range(1, 5)])


_CAUSE_SQL = """CASE WHEN regexp_matches(lower(description), 'cb|rain|show|thunderstorm') THEN 'CB'
 WHEN regexp_matches(lower(description), 'visibility|ceiling|vis|lvp|l\\.v\\.p\\.') THEN 'VISIBILITY/CEILING'
 WHEN contains(lower(description), 'wind') THEN 'WIND' WHEN contains(lower(description), 'fog') THEN 'FOG'
 WHEN regexp_matches(lower(description), 'snow|freez|icing|ice') THEN 'SNOW/ICE' ELSE 'OTHER' END"""


@query("cause_class", "T-04", f"SELECT doc_id, {_CAUSE_SQL} AS cause FROM causes")
def _(spark, d):
    return S.causes(spark, d).select("doc_id", T.cause_class("description").alias("cause"))


@query(
    "phenomenon_flags",
    "T-05",
    "SELECT event_id, "
    + ", ".join(
        "CAST(" + " OR ".join(f"contains(report, '{w}')" for w in words) + f" AS INTEGER) AS {n}"
        for n, words in T.PHENOMENA.items()
    )
    + " FROM raw_report",
)
def _(spark, d):
    return S.raw_reports(spark, d).select("event_id", *T.phenomenon_flags("report"))


_ROUND_AWAY = "(sign({c}) * floor(abs({c}) + 0.5))"


@query(
    "decode_reports",
    "T-06",
    f"""SELECT event_id,
 CASE WHEN event_id % 17 = 0 OR event_id % 11 = 0 THEN NULL ELSE wind_direction END AS wind_direction,
 CASE WHEN event_id % 17 <> 0 THEN wind_speed_kt END AS wind_speed_kt,
 CASE WHEN event_id % 17 <> 0 THEN wind_gust_kt END AS wind_gust_kt, visibility_m, ceil_lo AS ceiling_ft,
 {r("CASE WHEN event_id % 13 <> 0 THEN " + _ROUND_AWAY.format(c="temperature_c") + " END")} AS temperature_c,
 {r("CASE WHEN event_id % 13 <> 0 THEN " + _ROUND_AWAY.format(c="dewpoint_c") + " END")} AS dewpoint_c,
 floor(pressure_hpa) AS pressure_hpa
FROM (SELECT *, floor(ceiling_ft / 100) * 100 AS ceil_lo FROM obs)""",
)
def _(spark, d):
    out = S.raw_reports(spark, d).select("event_id", *T.decode_report("report"))
    zero = [(F.col(c) + F.lit(0.0)).alias(c) for c in ("temperature_c", "dewpoint_c")]
    rest = [c for c in out.columns if c not in ("temperature_c", "dewpoint_c")]
    return out.select(*rest, *zero)


@query(
    "decode_mixed_reports",
    "T-06",
    f"""SELECT event_id, CASE WHEN k <> 6 THEN wind_direction END AS wind_direction,
 {r("CASE WHEN k = 1 THEN floor(wind_speed_kt / 2) * 1.9438444924::DOUBLE WHEN k <> 6 THEN wind_speed_kt END", 6)} AS wind_speed_kt,
 {r("CASE k WHEN 2 THEN 10000 WHEN 3 THEN (event_id % 5 + 0.5::DOUBLE) * 1609.344::DOUBLE WHEN 6 THEN NULL ELSE visibility_m END", 6)} AS visibility_m,
 CASE WHEN k NOT IN (2, 6) THEN floor(coalesce(ceiling_ft, 900) / 100) * 100 END AS ceiling_ft,
 {r("CASE WHEN k <> 6 THEN " + _ROUND_AWAY.format(c="temperature_c") + " END")} AS temperature_c,
 {r("CASE WHEN k NOT IN (4, 6) THEN " + _ROUND_AWAY.format(c="dewpoint_c") + " END")} AS dewpoint_c,
 {r("CASE WHEN k = 4 THEN floor(pressure_hpa * 3) * 0.338638866667::DOUBLE ELSE floor(pressure_hpa) END", 6)} AS pressure_hpa
FROM (SELECT *, event_id % 8 AS k FROM obs)""",
)
def _(spark, d):
    out = S.mixed_reports(spark, d).select("event_id", *T.decode_report("report"))
    rounded = ("wind_speed_kt", "visibility_m", "temperature_c", "dewpoint_c", "pressure_hpa")
    return out.select("event_id", "wind_direction", "ceiling_ft", *[(rnd(c, 6) + F.lit(0.0)).alias(c) for c in rounded])


@query(
    "clip_to_bounds",
    "T-11",
    "SELECT event_id, CASE WHEN ceiling_ft IS NOT NULL THEN greatest(500, least(3000, ceiling_ft)) END AS ceiling_ft FROM obs",
)
def _(spark, d):
    return S.observations(spark, d).select("event_id", clip("ceiling_ft", 500.0, 3000.0).alias("ceiling_ft"))


@query(
    "one_hot_vectors",
    "T-10",
    """SELECT event_id, dense_rank() OVER (ORDER BY station) - 1 AS place, (SELECT count(DISTINCT station) FROM obs) AS size FROM obs""",
)
def _(spark, d):
    """One sparse vector for all stations: the place that is set, and the size."""
    out = prep.one_hot_vector(S.observations(spark, d).select("event_id", "station"), "station", "v")
    return out.select("event_id", prep.vector_place("v").alias("v")).select("event_id", "v.place", "v.size")


@query(
    "one_hot_indicators",
    "T-10",
    """SELECT o_orderkey, CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS "priority_1-URGENT",
 CAST(o_orderpriority = '2-HIGH' AS INTEGER) AS "priority_2-HIGH", CAST(o_orderpriority = '3-MEDIUM' AS INTEGER) AS "priority_3-MEDIUM",
 CAST(o_orderpriority = '4-NOT SPECIFIED' AS INTEGER) AS "priority_4-NOT SPECIFIED",
 CAST(o_orderpriority = '5-LOW' AS INTEGER) AS "priority_5-LOW" FROM categories""",
)
def _(spark, d):
    out = prep.one_hot(S.categories(spark, d).select("o_orderkey", "o_orderpriority"), "o_orderpriority", "priority")
    return out.drop("o_orderpriority")


