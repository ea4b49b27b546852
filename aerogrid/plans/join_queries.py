"""Grid construction, joins and interval labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerogrid.functions import timefeat as D
from aerogrid.functions import weather as M
from aerogrid.functions.num import rnd
from aerogrid.functions.text import phenomenon_flags
from aerogrid.operators import filters, grid, intervals, joins, prep
from aerogrid.plans import facades
from aerogrid.plans.oracle_views import r
from aerogrid.plans.registry import query
from aerogrid.plans.window_queries import labelled, zeroed
from aerogrid.session import settle
from aerogrid.sources import standins as S


def active_intervals(spark, d):
    return filters.usable_intervals(S.intervals(spark, d), None, None)


@query(
    "resample_half_hour",
    "A-01",
    "SELECT station, ts, "
    + ", ".join(
        f"{r(c, 8)} AS {c}"
        for c in (
            "wind_speed_kt wind_direction wind_gust_kt visibility_m ceiling_ft temperature_c dewpoint_c pressure_hpa".split()
        )
    )
    + " FROM resampled",
)
def _(spark, d):
    return zeroed(grid.resample(S.observations(spark, d)), ["station", "ts"], 8)


@query(
    "resample_phenomena",
    "A-01 T-05",
    """SELECT station, time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '2000-01-01') AS ts,
 max(CAST(contains(report, 'FG') OR contains(report, 'BR') AS INTEGER)) AS has_fog,
 max(CAST(contains(report, 'RA') OR contains(report, 'DZ') AS INTEGER)) AS has_rain,
 max(CAST(contains(report, 'SN') OR contains(report, 'SG') AS INTEGER)) AS has_snow,
 max(CAST(contains(report, 'TS') AS INTEGER)) AS has_thunderstorm,
 max(CAST(contains(report, 'FZ') OR contains(report, 'IC') AS INTEGER)) AS has_ice FROM raw_report GROUP BY ALL""",
)
def _(spark, d):
    return grid.resample(S.raw_reports(spark, d).select("station", "ts", *phenomenon_flags("report")))


@query("grid_bounds", "A-02", "SELECT DISTINCT station, lo, hi FROM obs, grid_bounds")
def _(spark, d):
    return grid.station_bounds(S.observations(spark, d))


@query("station_time_grid", "J-13", "SELECT station, ts FROM grid")
def _(spark, d):
    return grid.time_grid(S.observations(spark, d))


@query(
    "grid_with_observations",
    "J-01",
    f"""SELECT g.station, g.ts, {r('s.temperature_c', 8)} AS temperature_c, {r('s.visibility_m', 8)} AS visibility_m,
 {r('s.pressure_hpa', 8)} AS pressure_hpa FROM grid g LEFT JOIN resampled s ON g.station = s.station AND g.ts = s.ts""",
)
def _(spark, d):
    out = grid.on_grid(S.observations(spark, d), fill_minutes=None)
    return zeroed(out.select("station", "ts", "temperature_c", "visibility_m", "pressure_hpa"), ["station", "ts"], 8)


@query(
    "grid_labels_closed",
    "J-02",
    """SELECT g.station, g.ts, CAST(count(i.ordinal) > 0 AS INTEGER) AS has_regulation,
 coalesce(max(CAST(coalesce(regexp_matches(upper(reason),
   'WEATHER|WX|CB|TS|FOG|WIND|SNOW|ICE|VISIBILITY|CEILING|STORM'), false) AS INTEGER)), 0) AS has_weather_regulation,
 coalesce(max(severity), 0) AS regulation_severity
FROM grid g LEFT JOIN active i ON g.station = i.station AND g.ts BETWEEN i.start_time AND i.end_time GROUP BY ALL""",
)
def _(spark, d):
    return facades.regulation_labels(
        grid.time_grid(S.observations(spark, d)), filters.with_weather_flag(active_intervals(spark, d)), 30
    )


@query(
    "point_labels_closed",
    "J-02",
    """SELECT o.event_id, count(i.ordinal) AS active_count, max(severity) AS severity FROM obs o
LEFT JOIN active i ON o.station = i.station AND o.ts BETWEEN i.start_time AND i.end_time GROUP BY o.event_id""",
)
def _(spark, d):
    kept = [intervals.Measure("active_count", "sum", "1"), intervals.Measure("severity", "max", "severity")]
    out = intervals.label_points(S.observations(spark, d), active_intervals(spark, d), kept, closed=True)
    return out.select("event_id", F.coalesce("active_count", F.lit(0)).alias("active_count"), "severity")


@query("point_labels_half_open", "J-03", "SELECT event_id, station, ts, y FROM labelled")
def _(spark, d):
    return labelled(spark, d).select("event_id", "station", "ts", "y")


@query(
    "bucket_overlap_labels",
    "J-04",
    """SELECT g.station, g.ts, CAST(count(i.ordinal) > 0 AS INTEGER) AS regulation_binary FROM grid g LEFT JOIN active i
 ON g.station = i.station AND ((i.start_time < g.ts + INTERVAL 30 MINUTE AND i.start_time >= g.ts)
   OR (i.start_time <= g.ts AND g.ts < i.end_time)) GROUP BY ALL""",
)
def _(spark, d):
    out = intervals.grid_labels(
        grid.time_grid(S.observations(spark, d)), active_intervals(spark, d), 30, [intervals.ACTIVE], "overlap"
    )
    return out.select("station", "ts", F.coalesce("active", F.lit(0)).alias("regulation_binary"))


def windowed(spark, d, strategy="auto"):
    """Observations with the labels of the sampling windows."""
    windows = intervals.sampling_windows(filters.usable_intervals(S.intervals(spark, d)))
    return intervals.label_with_windows(S.observations(spark, d), windows, strategy)


def _in_both_ways(strategy):
    """The same labels by one strategy, whatever the sizes are."""

    @query(f"point_labels_half_open_{strategy}", "J-03", "SELECT event_id, station, ts, y FROM labelled")
    def _(spark, d):
        out = intervals.label_points(S.observations(spark, d), active_intervals(spark, d), strategy=strategy)
        return out.select("event_id", "station", "ts", F.coalesce("active", F.lit(0)).alias("y"))

    @query(f"extended_window_labels_{strategy}", "J-05", "SELECT event_id, station, ts, has_regulation, in_window FROM windowed")
    def _(spark, d):
        return windowed(spark, d, strategy).select("event_id", "station", "ts", "has_regulation", "in_window")

    @query(f"hours_to_interval_{strategy}", "J-06", "SELECT event_id, station, ts, time_to_regulation FROM windowed")
    def _(spark, d):
        return windowed(spark, d, strategy).select("event_id", "station", "ts", "time_to_regulation")


_in_both_ways("broadcast")
_in_both_ways("sorted")


@query("extended_window_labels", "J-05", "SELECT event_id, station, ts, has_regulation, in_window FROM windowed")
def _(spark, d):
    return windowed(spark, d).select("event_id", "station", "ts", "has_regulation", "in_window")


@query(
    "hours_to_interval",
    "J-06",
    "SELECT event_id, station, ts, time_to_regulation FROM windowed",
)
def _(spark, d):
    return windowed(spark, d).select("event_id", "station", "ts", "time_to_regulation")


@query(
    "interval_imminence",
    "M-14",
    f"""WITH m AS (SELECT event_id, coalesce(time_to_regulation, (SELECT median(time_to_regulation) FROM windowed)) AS h FROM windowed)
SELECT event_id, {r('h', 3)} AS hours_to_regulation, CAST(h >= 0 AND h <= 2 AS INTEGER) AS regulation_imminent FROM m""",
)
def _(spark, d):
    hours = settle(windowed(spark, d).select("event_id", "time_to_regulation"))
    filled = prep.impute(hours, ["time_to_regulation"])
    out = intervals.imminence(filled).select("event_id", "hours_to_regulation", "regulation_imminent")
    return out.withColumn("hours_to_regulation", rnd("hours_to_regulation", 3) + F.lit(0.0))


@query(
    "forecast_on_grid",
    "J-07",
    """WITH e AS (SELECT station, issue_time, unnest(generate_series(valid_from, valid_to, INTERVAL 30 MINUTE)) AS ts, wind_speed_kt,
  wind_direction, visibility_m, ceiling_ft FROM forecast),
 n AS (SELECT *, row_number() OVER (PARTITION BY station, ts ORDER BY issue_time DESC) AS rn FROM e)
SELECT g.station, g.ts, n.wind_speed_kt AS wind_speed_kt_forecast, n.wind_direction AS wind_direction_forecast,
 n.visibility_m AS visibility_m_forecast, n.ceiling_ft AS ceiling_ft_forecast
FROM grid g LEFT JOIN n ON g.station = n.station AND g.ts = n.ts AND n.rn = 1""",
)
def _(spark, d):
    span = grid.grid_span(S.observations(spark, d))
    steps = grid.forecast_on_grid(S.forecasts(spark, d), facades.FORECAST_COLUMNS, within=span)
    return grid.join_steps(grid.time_grid(S.observations(spark, d)), steps, "left", grid.strategy_within(steps, span))


@query(
    "features_with_labels",
    "J-08",
    f"""WITH l AS (SELECT DISTINCT g.station, g.ts FROM grid g JOIN active i ON g.station = i.station AND g.ts >= i.start_time AND g.ts < i.end_time)
SELECT s.station, s.ts, {r('s.temperature_c', 8)} AS temperature_c, 1 AS y FROM resampled s JOIN l ON s.station = l.station AND s.ts = l.ts""",
)
def _(spark, d):
    obs = S.observations(spark, d)
    labels = intervals.grid_labels(
        grid.time_grid(obs), active_intervals(spark, d), 30, [intervals.ACTIVE], "half_open"
    ).where(F.col("active") == 1)
    joined = grid.join_steps(grid.resample(obs), labels, "inner")
    return joined.select("station", "ts", (rnd("temperature_c", 8) + F.lit(0.0)).alias("temperature_c"), F.lit(1).alias("y"))


@query(
    "sampling_windows",
    "J-09 S-10",
    f"""SELECT station, window_start, window_end, start_time, end_time, reason, {r('duration_hours')} AS duration_hours, ordinal FROM windows""",
)
def _(spark, d):
    out = intervals.sampling_windows(filters.usable_intervals(S.intervals(spark, d)))
    return out.withColumn("duration_hours", rnd("duration_hours"))


@query(
    "observations_at_label_times",
    "J-10",
    """SELECT event_id, station, ts FROM obs o WHERE EXISTS (SELECT 1 FROM intervals i
 WHERE i.station = o.station AND i.start_time = date_trunc('minute', o.ts))""",
)
def _(spark, d):
    times = S.intervals(spark, d).select("station", F.col("start_time").alias("minute"))
    obs = S.observations(spark, d).withColumn("minute", D.floor_time("ts", 1))
    return joins.at_times(obs, times, ["station", "minute"]).select("event_id", "station", "ts")


@query(
    "stations_with_many_intervals",
    "J-11",
    """WITH c AS (SELECT station, count(*) AS active_intervals FROM active WHERE station IN (SELECT station FROM obs)
 GROUP BY station HAVING count(*) > 20 ORDER BY active_intervals DESC, station LIMIT 5)
SELECT * FROM c UNION ALL SELECT 'EGLL', 0 WHERE NOT EXISTS (SELECT 1 FROM c)""",
)
def _(spark, d):
    return joins.select_stations(active_intervals(spark, d), S.observations(spark, d), 20, 5, "EGLL")


@query(
    "join_column_blocks",
    "J-12",
    """SELECT station, row_number() OVER (PARTITION BY station ORDER BY ts, event_id) - 1 AS row_no, temperature_c, dewpoint_c,
 visibility_m, ceiling_ft, wind_speed_kt, pressure_hpa FROM obs""",
)
def _(spark, d):
    obs = S.observations(spark, d)
    blocks = [
        obs.select("station", "ts", "event_id", "temperature_c", "dewpoint_c"),
        obs.select("station", "ts", "event_id", "visibility_m", "ceiling_ft"),
        obs.select("station", "ts", "event_id", "wind_speed_kt", "pressure_hpa"),
    ]
    return joins.side_by_side(blocks, "ts", "event_id")


@query(
    "positive_times_by_station",
    "U-03",
    """WITH b AS (SELECT DISTINCT g.station, g.ts FROM grid g JOIN active i ON g.station = i.station
 AND ((i.start_time < g.ts + INTERVAL 30 MINUTE AND i.start_time >= g.ts) OR (i.start_time <= g.ts AND g.ts < i.end_time)))
SELECT ts, string_agg(station, ',' ORDER BY station) AS stations, count(*) AS n_stations FROM b GROUP BY ts""",
)
def _(spark, d):
    """All stations that are positive at a time; the wide form with a column for each is `joins.wide_times`."""
    labels = intervals.grid_labels(
        grid.time_grid(S.observations(spark, d)), active_intervals(spark, d), 30, [intervals.ACTIVE], "overlap"
    ).where(F.col("active") == 1)
    return joins.positive_times(labels)


@query(
    "positive_times_wide",
    "U-03",
    """WITH b AS (SELECT DISTINCT g.station, g.ts FROM grid g JOIN active i ON g.station = i.station
 AND ((i.start_time < g.ts + INTERVAL 30 MINUTE AND i.start_time >= g.ts) OR (i.start_time <= g.ts AND g.ts < i.end_time)))
SELECT ts, """
    + ", ".join(f"max(CAST(ascii(station) % 26 = {i} AS INTEGER)) AS group_{i}" for i in range(26))
    + " FROM b GROUP BY ts",
)
def _(spark, d):
    labels = intervals.grid_labels(
        grid.time_grid(S.observations(spark, d)), active_intervals(spark, d), 30, [intervals.ACTIVE], "overlap"
    ).where(F.col("active") == 1)
    groups = labels.withColumn("station", F.concat(F.lit("group_"), F.ascii("station") % 26))
    return joins.wide_times(groups, [f"group_{i}" for i in range(26)])


@query(
    "union_of_samples",
    "U-01",
    """SELECT event_id, station, temperature_c, CAST(NULL AS DOUBLE) AS visibility_m FROM obs WHERE station = 'EGLL'
UNION ALL SELECT event_id, station, CAST(NULL AS DOUBLE), visibility_m FROM obs WHERE station <> 'EGLL'""",
)
def _(spark, d):
    obs = S.observations(spark, d)
    return joins.union_all(
        [
            obs.where(F.col("station") == "EGLL").select("event_id", "station", "temperature_c"),
            obs.where(F.col("station") != "EGLL").select("event_id", "station", "visibility_m"),
        ]
    )


@query("distinct_stations", "U-02", "SELECT DISTINCT station FROM obs")
def _(spark, d):
    return S.observations(spark, d).select("station").distinct()


@query(
    "sort_by_station_and_time",
    "O-01",
    "SELECT station, ts, event_id, temperature_c FROM obs ORDER BY station, ts, event_id",
)
def _(spark, d):
    return S.observations(spark, d).select("station", "ts", "event_id", "temperature_c").orderBy("station", "ts", "event_id")


@query(
    "top_stations_by_active",
    "O-02",
    """SELECT station, count(*) AS active_intervals, sum(delay_min) AS total_delay FROM active
GROUP BY station ORDER BY active_intervals DESC, station DESC LIMIT 15""",
)
def _(spark, d):
    return (
        active_intervals(spark, d)
        .groupBy("station")
        .agg(F.count(F.lit(1)).alias("active_intervals"), F.sum("delay_min").alias("total_delay"))
        .orderBy(F.desc("active_intervals"), F.desc("station"))
        .limit(15)
    )


@query(
    "active_rate_by_category_and_hour",
    "S-04 S-06 F-03 A-02 J-13 A-01 J-01 W-11 J-03 M-10 D-01 A-07",
    f"""WITH f AS (SELECT g.station, g.ts, last_value(s.visibility_m IGNORE NULLS) OVER w AS visibility_m,
  last_value(s.ceiling_ft IGNORE NULLS) OVER w AS ceiling_ft
  FROM grid g LEFT JOIN resampled s ON g.station = s.station AND g.ts = s.ts
  WINDOW w AS (PARTITION BY g.station ORDER BY g.ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
 l AS (SELECT f.*, CASE WHEN EXISTS (SELECT 1 FROM windows i WHERE i.station = f.station AND f.ts >= i.start_time AND f.ts < i.end_time)
   THEN 1 ELSE 0 END AS y FROM f)
SELECT station, CASE WHEN ceiling_ft IS NULL OR visibility_m IS NULL THEN 'unknown' WHEN ceiling_ft < 200 OR visibility_m < 550 THEN 'LIFR'
 WHEN ceiling_ft < 500 OR visibility_m < 1600 THEN 'IFR' WHEN ceiling_ft < 1000 OR visibility_m < 5000 THEN 'MVFR' ELSE 'VFR' END
 AS flight_category, hour(ts) AS "hour", count(*) AS n, sum(y) AS active, {r('avg(y)')} AS active_rate FROM l GROUP BY ALL""",
)
def _(spark, d):
    obs = S.observations(spark, d).select("station", "ts", "visibility_m", "ceiling_ft")
    steps = grid.on_grid(obs)
    usable = filters.usable_intervals(S.intervals(spark, d))
    labels = intervals.grid_labels(steps, usable, 30, [intervals.ACTIVE], "half_open", grid.grid_span(obs))
    return (
        labels.select(
            "station",
            M.flight_category("ceiling_ft", "visibility_m").alias("flight_category"),
            D.hour("ts").alias("hour"),
            F.coalesce("active", F.lit(0)).alias("y"),
        )
        .groupBy("station", "flight_category", "hour")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("active"), rnd(F.avg("y")).alias("active_rate"))
    )


def _feature_matrix_sql():
    """Grid, reduced observations, forecasts, labels, clock and weather features, then the missing-value rules."""
    obs = "wind_speed_kt wind_direction wind_gust_kt visibility_m ceiling_ft temperature_c dewpoint_c pressure_hpa".split()
    flags = {"has_fog": ("FG", "BR"), "has_rain": ("RA", "DZ"), "has_snow": ("SN", "SG"), "has_thunderstorm": ("TS",), "has_ice": ("FZ", "IC")}
    hit = {n: " OR ".join(f"contains(report, '{c}')" for c in codes) for n, codes in flags.items()}
    values = [*obs, *flags]
    forecast = {f"{c}_forecast": c for c in facades.FORECAST_COLUMNS}
    clock = {
        "hour": "hour(ts)", "day_of_week": "isodow(ts) - 1", "month": "month(ts)", "is_weekend": "CAST(isodow(ts) >= 6 AS INTEGER)",
        "hour_sin": "sin(2 * pi() * hour(ts) / 24)", "hour_cos": "cos(2 * pi() * hour(ts) / 24)",
        "month_sin": "sin(2 * pi() * month(ts) / 12)", "month_cos": "cos(2 * pi() * month(ts) / 12)",
    }
    magnus = "17.27::DOUBLE * {0} / (237.7::DOUBLE + {0})"
    kmh = "(wind_speed_kt * 1.852::DOUBLE)"
    power = f"pow({kmh}, 0.16::DOUBLE)"
    chill = f"13.12::DOUBLE + 0.6215::DOUBLE * temperature_c - 11.37::DOUBLE * {power} + 0.3965::DOUBLE * temperature_c * {power}"
    weather = {
        "relative_humidity": f"CASE WHEN temperature_c IS NOT NULL AND dewpoint_c IS NOT NULL THEN greatest(0, least(100, 100 * exp({magnus.format('dewpoint_c')} - {magnus.format('temperature_c')}))) END",
        "wind_chill": f"CASE WHEN temperature_c <= 10 AND {kmh} >= 4.8::DOUBLE THEN {chill} ELSE temperature_c END",
        "weather_severity": "has_fog * 2 + has_thunderstorm * 3 + has_ice * 3 + CAST(coalesce(visibility_m < 1000, false) AS INTEGER) * 2 + CAST(coalesce(ceiling_ft < 500, false) AS INTEGER) * 2",
    }
    levels = {
        "vis_category": ("visibility_m", "'very_poor' 1000 'poor' 3000 'moderate' 5000 'good' 10000 'excellent'".split()),
        "ceiling_category": ("ceiling_ft", "'very_low' 200 'low' 500 'moderate' 1000 'high' 3000 'unlimited'".split()),
    }
    category = {
        n: f"CASE WHEN {c} <= 0 THEN NULL " + " ".join(f"WHEN {c} <= {at} THEN {v}" for v, at in zip(x[::2], x[1::2], strict=False)) + f" WHEN {c} > {x[-2]} THEN {x[-1]} END"
        for n, (c, x) in levels.items()
    }
    labels = ["has_regulation", "has_weather_regulation", "regulation_severity"]
    numbers = [*values, *forecast, *labels, *clock, *weather]
    whole = {*flags, *labels, "hour", "day_of_week", "month", "is_weekend", "weather_severity"}
    filled = lambda c: f"coalesce(last_value({c} IGNORE NULLS) OVER back, first_value({c} IGNORE NULLS) OVER ahead)"
    last = lambda c: f"coalesce({c}, 0)" if c in whole else r(f"coalesce({c}, 0)", 6)
    return f"""WITH flagged AS (SELECT o.*, {", ".join(f"CAST({x} AS INTEGER) AS {n}" for n, x in hit.items())} FROM obs o JOIN raw_report USING (event_id)),
 reduced AS (SELECT station, time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '2000-01-01') AS ts, {", ".join(f"{'max' if c == 'wind_gust_kt' else 'min' if c in ('visibility_m', 'ceiling_ft') else 'avg'}({c}) AS {c}" for c in obs)},
  {", ".join(f"max({c}) AS {c}" for c in flags)} FROM flagged GROUP BY ALL),
 steps AS (SELECT g.station, g.ts, {", ".join(f"last_value(s.{c} IGNORE NULLS) OVER w AS {c}" for c in values)} FROM grid g LEFT JOIN reduced s ON g.station = s.station AND g.ts = s.ts
  WINDOW w AS (PARTITION BY g.station ORDER BY g.ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
 spread AS (SELECT station, issue_time, unnest(generate_series(valid_from, valid_to, INTERVAL 30 MINUTE)) AS ts, {", ".join(f"{c} AS {n}" for n, c in forecast.items())} FROM forecast),
 newest AS (SELECT * FROM spread QUALIFY row_number() OVER (PARTITION BY station, ts ORDER BY issue_time DESC) = 1),
 covered AS (SELECT g.station, g.ts, CAST(count(i.ordinal) > 0 AS INTEGER) AS has_regulation, coalesce(max(CAST(coalesce(regexp_matches(upper(reason),
   'WEATHER|WX|CB|TS|FOG|WIND|SNOW|ICE|VISIBILITY|CEILING|STORM'), false) AS INTEGER)), 0) AS has_weather_regulation, coalesce(max(severity), 0) AS regulation_severity
  FROM grid g LEFT JOIN active i ON g.station = i.station AND g.ts BETWEEN i.start_time AND i.end_time GROUP BY ALL),
 made AS (SELECT s.*, {", ".join(f"n.{c}" for c in forecast)}, {", ".join(f"c.{c}" for c in labels)} FROM steps s JOIN covered c ON s.station = c.station AND s.ts = c.ts
  LEFT JOIN newest n ON s.station = n.station AND s.ts = n.ts),
 featured AS (SELECT *, {", ".join(f'{x} AS "{n}"' for n, x in {**clock, **weather, **category}.items())} FROM made),
 flowing AS (SELECT station, ts, {", ".join(category)}, {", ".join(f'{filled(chr(34) + c + chr(34))} AS "{c}"' for c in numbers)} FROM featured
  WINDOW back AS (PARTITION BY station ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), ahead AS (PARTITION BY station ORDER BY ts ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
SELECT station, ts, {", ".join(f"coalesce({c}, (SELECT {c} FROM flowing WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)) AS {c}" for c in category)},
 {", ".join(f'{last(chr(34) + c + chr(34)) if c not in whole else f"coalesce({chr(34)}{c}{chr(34)}, 0)"} AS "{c}"' for c in numbers)} FROM flowing"""


FEATURE_MATRIX_SQL = _feature_matrix_sql()


def feature_matrix(spark, d):
    reports = S.raw_reports(spark, d).select("event_id", *phenomenon_flags("report"))
    obs = S.observations(spark, d).join(reports, "event_id")
    return facades.feature_matrix(obs, S.forecasts(spark, d), active_intervals(spark, d))


@query("feature_matrix", "S-16", FEATURE_MATRIX_SQL)
def _(spark, d):
    out = feature_matrix(spark, d)
    return out.withColumns({c: F.round(c, 6) + F.lit(0.0) for c, kind in out.dtypes if kind == "double"})


@query(
    "label_rate_by_condition",
    "A-07",
    f"""WITH c AS (SELECT y, unnest([struct_pack(c := 'low_visibility', v := CAST(visibility_m < 5000 AS INTEGER)),
  struct_pack(c := 'low_ceiling', v := CAST(coalesce(ceiling_ft < 1000, false) AS INTEGER)),
  struct_pack(c := 'high_wind', v := CAST(wind_speed_kt > 15 AS INTEGER)),
  struct_pack(c := 'fog_risk', v := CAST(temperature_c - dewpoint_c < 3 AND visibility_m < 5000 AS INTEGER))]) AS e FROM labelled)
SELECT e.c AS condition, e.v AS present, count(*) AS n, sum(y) AS positives, {r('avg(y)')} AS positive_rate FROM c GROUP BY ALL""",
)
def _(spark, d):
    made = M.condition_flags("visibility_m", "ceiling_ft", "wind_speed_kt", "temperature_c", "dewpoint_c")
    names = ["low_visibility", "low_ceiling", "high_wind", "fog_risk"]
    return joins.rates_by_condition(labelled(spark, d).select("y", *made), names, "y")


@query(
    "label_rate_by_station",
    "A-07",
    f"SELECT station, count(*) AS n, sum(y) AS positives, {r('avg(y)')} AS positive_rate FROM labelled GROUP BY station",
)
def _(spark, d):
    return (
        labelled(spark, d)
        .groupBy("station")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"), rnd(F.avg("y")).alias("positive_rate"))
    )


@query(
    "label_rate_by_hour",
    "A-08",
    f"SELECT hour(ts) AS \"hour\", sum(y) AS active, {r('avg(y)')} AS active_rate FROM labelled GROUP BY ALL",
)
def _(spark, d):
    return (
        labelled(spark, d)
        .groupBy(D.hour("ts").alias("hour"))
        .agg(F.sum("y").alias("active"), rnd(F.avg("y")).alias("active_rate"))
    )


@query(
    "sampling_summary",
    "A-22",
    f"""WITH s AS (SELECT has_regulation, in_window, count(*) AS n FROM windowed GROUP BY ALL),
 w AS (SELECT count(*) AS windows, avg(duration_hours) AS mean_interval, avg(duration_hours + 8) AS mean_window,
  avg(CAST(coalesce(regexp_matches(upper(reason), 'WEATHER|WX|CB|TS|FOG|WIND|SNOW|ICE|VISIBILITY|CEILING|STORM'), false) AS INTEGER)) AS weather_share FROM windows)
SELECT has_regulation, in_window, n, windows, {r('mean_interval')} AS mean_interval_hours, {r('mean_window')} AS mean_window_hours,
 {r('weather_share')} AS weather_share FROM s, w""",
)
def _(spark, d):
    windows = intervals.sampling_windows(filters.usable_intervals(S.intervals(spark, d)))
    return facades.sampling_summary(windowed(spark, d), windows)


