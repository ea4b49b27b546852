"""Sources and sinks.

Each query writes what it derives from the given tables below the checkpoint folder, in the layout the
reader expects, and returns what the reader makes of it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from aerogrid.functions import text as T
from aerogrid.functions.num import rnd
from aerogrid.operators import ordering, results
from aerogrid.plans import facades, join_queries
from aerogrid.plans.oracle_views import r
from aerogrid.plans.registry import query
from aerogrid.session import scratch_path, settle_by_column
from aerogrid.sources import files, storage
from aerogrid.sources import standins as S

MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"
_AWAY = "(sign({c}) * floor(abs({c}) + 0.5))"


GROUPS = 16  # folders that a task writes a file to, for any number of stations
NO_STATION = "__HIVE_DEFAULT_PARTITION__"  # the folder that rows without a station go to in a layout by station


def _in_groups(rows, root):
    """Report files in a few folders by station; the rows name their station, as thousands of stations make too many folders."""
    station = F.coalesce(F.nullif("station", F.lit("")), F.lit(NO_STATION))
    others = [c for c in rows.columns if c != "station"]
    grouped = rows.select(station.alias("station"), *others, F.pmod(F.xxhash64("station"), F.lit(GROUPS)).alias("group"))
    grouped.write.partitionBy("group").option("header", True).option("timestampNTZFormat", MICROS).csv(root)


@query(
    "read_observation_files",
    "S-01 S-02 T-06 U-01",
    f"""SELECT station, ts, CASE WHEN event_id % 17 <> 0 THEN wind_speed_kt END AS wind_speed_kt, visibility_m,
 {r("CASE WHEN event_id % 13 <> 0 THEN " + _AWAY.format(c="temperature_c") + " END")} AS temperature_c FROM obs
WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-15 00:00:00'""",
)
def _(spark, d):
    root = scratch_path(spark, "observations")
    rows = S.raw_reports(spark, d).select("station", F.col("ts").alias("datetime"), "report")
    _in_groups(rows, root)
    read = files.read_observations(spark, root, None, "2024-01-05", "2024-01-15", "ISO-8859-1", layout="group=*")
    return read.select(
        "station", "ts", "wind_speed_kt", "visibility_m", (F.col("temperature_c") + F.lit(0.0)).alias("temperature_c")
    )


def _mixed_files(spark, d):
    """Report files in folders by station group: those of even groups in UTF-8, the others in ISO-8859-1, some rows without a time."""
    root = scratch_path(spark, "mixed")
    k = F.ascii(F.substring("station", 1, 1)) + F.ascii(F.substring("station", 4, 1))
    time = F.when(F.col("event_id") % 19 == 0, F.lit("no time")).otherwise(F.date_format("ts", MICROS))
    rows = S.raw_reports(spark, d).select(
        F.concat(F.lit("G"), k % 10).alias("station"), k.alias("_k"), time.alias("datetime"), F.concat("report", F.lit(" RMK "), "event_id", F.lit(" \u00e9t\u00e9")).alias("report")
    )
    for odd, encoding in ((0, "UTF-8"), (1, "ISO-8859-1")):
        own = rows.where(F.col("_k") % 2 == odd).drop("_k")
        own.write.mode("append").partitionBy("station").option("header", True).option("encoding", encoding).csv(root)
    return root


_GROUP = "'G' || ((ascii(substr(station, 1, 1)) + ascii(substr(station, 4, 1))) % 10)"


@query(
    "read_mixed_encodings",
    "S-02 S-01",
    f"""SELECT {_GROUP} AS station, ts, event_id || ' \u00e9t\u00e9' AS remark, CASE WHEN event_id % 17 <> 0 THEN wind_speed_kt END AS wind_speed_kt, visibility_m FROM obs
WHERE event_id % 19 <> 0 AND ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-15 00:00:00'""",
)
def _(spark, d):
    read = files.read_observations(spark, _mixed_files(spark, d), None, "2024-01-05", "2024-01-15", "auto", layout="station={station}")
    return read.select("station", "ts", F.split("report", " RMK ")[1].alias("remark"), "wind_speed_kt", "visibility_m")


@query(
    "malformed_lines",
    "S-02",
    f"""SELECT {_GROUP} AS station, count(*) AS n_lines, sum(event_id) AS remarks FROM obs WHERE event_id % 19 = 0 GROUP BY 1""",
)
def _(spark, d):
    bad = files.malformed_rows(spark, f"{_mixed_files(spark, d)}/station=*", encoding="auto")
    remark = F.regexp_extract("line", r"RMK ([0-9]+) \u00e9t\u00e9", 1).cast("long")
    return bad.groupBy("station").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(remark).alias("remarks"))


@query(
    "read_forecast_files",
    "S-03 T-08",
    """SELECT station, issue_time, valid_from, valid_to, wind_speed_kt, wind_direction, visibility_m, floor(ceiling_ft / 100) * 100 AS ceiling_ft
FROM forecast WHERE valid_from BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-15 00:00:00'""",
)
def _(spark, d):
    root = scratch_path(spark, "forecasts")
    rows = S.raw_forecast_reports(spark, d).select("station", "issue_time", "valid_from", "valid_to", "report")
    _in_groups(rows, root)
    read = files.read_forecasts(spark, root, None, "2024-01-05", "2024-01-15", layout="group=*")
    return read.select(
        "station", "issue_time", "valid_from", "valid_to", "wind_speed_kt", "wind_direction", "visibility_m", "ceiling_ft"
    )


@query(
    "read_interval_file",
    "S-04 F-05",
    """SELECT station, start_time, end_time, reason, cancelled, duration_min, coalesce(regexp_matches(upper(reason),
 'WEATHER|WX|CB|TS|FOG|WIND|SNOW|ICE|VISIBILITY|CEILING|STORM'), false) AS is_weather_related FROM intervals
WHERE start_time BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-25 00:00:00'""",
)
def _(spark, d):
    path = scratch_path(spark, "intervals")
    S.raw_intervals(spark, d).drop("ordinal", "severity").write.option("header", True).csv(path)
    read = files.read_intervals(spark, path, None, "2024-01-03", "2024-01-25")
    return read.select(
        "station", "start_time", "end_time", "reason", "cancelled", "duration_min", "is_weather_related"
    )


@query(
    "convert_interval_columns",
    "S-06",
    "SELECT station, start_time, end_time, reason, description, duration_min, delay_min, traffic AS regulated_traffic, cancelled FROM intervals",
)
def _(spark, d):
    return files.canonical_intervals(S.raw_intervals(spark, d)).drop("location_type")


_NAMES = """CASE o_orderkey % 5 WHEN 0 THEN 'METAR_' || strftime(o_orderdate, '%Y%m%d') || '.csv'
 WHEN 1 THEN 'METAR_' || strftime(o_orderdate, '%Y-%m-%d') || '_a.csv' WHEN 2 THEN 'METAR_' || strftime(o_orderdate, '%Y_%m_%d') || '.csv'
 WHEN 3 THEN 'METAR_20199950.csv' ELSE 'METAR_all.csv' END"""


@query(
    "files_in_date_range",
    "S-05",
    f"""SELECT o_orderkey, name FROM (SELECT o_orderkey, o_orderdate, {_NAMES} AS name FROM orders)
WHERE (o_orderkey % 5 < 3 AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31') OR o_orderkey % 5 = 3""",
)
def _(spark, d):
    k = F.col("o_orderkey") % 5
    name = F.concat(
        F.lit("METAR_"),
        F.when(k == 0, F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".csv")))
        .when(k == 1, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("_a.csv")))
        .when(k == 2, F.concat(F.date_format("o_orderdate", "yyyy_MM_dd"), F.lit(".csv")))
        .when(k == 3, "20199950.csv")
        .otherwise("all.csv"),
    )
    names = S.table(spark, d, "orders").select("o_orderkey", name.alias("name"))
    return names.where(files.in_name_range(F.concat(F.lit("/data/"), "name"), "1996-01-01", "1996-12-31"))


@query(
    "reports_from_date_parts",
    "S-07",
    "SELECT event_id, date_trunc('minute', ts) AS ts FROM raw_report WHERE contains(report, 'METAR')",
)
def _(spark, d):
    dump = S.raw_reports(spark, d).drop("ts")
    return files.reports_from_parts(dump).select("event_id", "ts")


@query(
    "read_wrapped_reports",
    "S-08",
    "SELECT station, issue_time, wind_speed_kt, visibility_m FROM forecast",
)
def _(spark, d):
    path = scratch_path(spark, "wrapped")
    rows = S.raw_forecast_reports(spark, d)
    wrapped = F.concat(
        F.date_format("issue_time", "yyyyMMddHHmm"),
        F.lit(" "),
        F.regexp_replace("report", " TEMPO", "\n      TEMPO"),
        F.lit("="),
    )
    rows.select(wrapped.alias("value")).write.text(path)
    read = files.read_wrapped_reports(spark, path)
    return read.select(
        F.substring("report", 5, 4).alias("station"),
        "issue_time",
        *[c for c, n in zip(T.decode_report("report"), T_NAMES) if n in ("wind_speed_kt", "visibility_m")],
    )


T_NAMES = [
    "wind_direction",
    "wind_speed_kt",
    "wind_gust_kt",
    "visibility_m",
    "ceiling_ft",
    "temperature_c",
    "dewpoint_c",
    "pressure_hpa",
]


@query(
    "forecast_periods",
    "T-08",
    """SELECT station, issue_time, valid_from, valid_to, 'MAIN' AS change_type, wind_speed_kt, wind_direction, visibility_m FROM forecast""",
)
def _(spark, d):
    reports = S.raw_forecast_reports(spark, d).select("station", "issue_time", "report")
    return files.forecast_periods(reports).select(
        "station", "issue_time", "valid_from", "valid_to", "change_type", "wind_speed_kt", "wind_direction", "visibility_m"
    )


@query(
    "forecast_wind_maximum",
    "T-09",
    "SELECT station, issue_time, wind_speed_kt + 5 AS max_wind_kt, wind_speed_kt + 14 AS max_gust_kt FROM forecast",
)
def _(spark, d):
    return S.raw_forecast_reports(spark, d).select("station", "issue_time", *T.forecast_wind_max("report"))


@query(
    "legacy_decode",
    "T-07",
    f"""WITH l AS (SELECT event_id, station, ts, CASE WHEN visibility_m = 9999 OR event_id % 17 = -1 THEN 10000 ELSE visibility_m END AS visibility_m,
 CASE WHEN ceiling_ft IS NULL THEN 0 WHEN event_id % 5 = 0 THEN 2 WHEN event_id % 2 = 0 THEN 3 ELSE 4 END AS ceiling_cover,
 CASE WHEN ceiling_ft IS NULL THEN 5000 WHEN event_id % 5 = 0 THEN floor(ceiling_ft / 50) * 100 ELSE floor(ceiling_ft / 100) * 100 END AS ceiling_ft,
 CASE WHEN event_id % 17 = 0 THEN 0 ELSE wind_speed_kt END AS wind_speed_kt,
 CASE WHEN event_id % 17 = 0 THEN 'No info' WHEN event_id % 11 = 0 THEN 'VRB' ELSE lpad(CAST(CAST(wind_direction AS BIGINT) AS VARCHAR), 3, '0') END AS wind_direction_text,
 CASE WHEN event_id % 13 <> 0 THEN {_AWAY.format(c="temperature_c")} END AS t, CASE WHEN event_id % 13 <> 0 THEN {_AWAY.format(c="dewpoint_c")} END AS dp FROM obs)
SELECT event_id, visibility_m, ceiling_cover, ceiling_ft, wind_speed_kt, wind_direction_text,
 {r('last_value(t IGNORE NULLS) OVER w')} AS temperature_c, {r('last_value(dp IGNORE NULLS) OVER w')} AS dewpoint_c FROM l
WINDOW w AS (PARTITION BY station ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def _(spark, d):
    fields = S.raw_reports(spark, d).select("event_id", "station", "ts", *T.legacy_fields("report"))
    filled = ordering.fill_series(fields, ["temperature_c", "dewpoint_c"], backward=False)
    rounded = [(rnd(c) + F.lit(0.0)).alias(c) for c in ("temperature_c", "dewpoint_c")]
    return filled.select(
        "event_id", "visibility_m", "ceiling_cover", "ceiling_ft", "wind_speed_kt", "wind_direction_text", *rounded
    )


@query(
    "save_and_load_features",
    "S-09",
    "SELECT event_id, station, temperature_c, visibility_m FROM obs WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'",
)
def _(spark, d):
    path = scratch_path(spark, "features")
    obs = S.observations(spark, d).select("event_id", "ts", "station", "temperature_c", "visibility_m")
    files.save_features(files.with_obs_date(obs), path, partition_by=["obs_date"])
    days = F.col("obs_date").between(F.lit("2024-01-10").cast("date"), F.lit("2024-01-12").cast("date"))
    return files.load_features(spark, path).where(days).select("event_id", "station", "temperature_c", "visibility_m")


@query(
    "save_and_load_csv",
    "S-09",
    "SELECT event_id, station, temperature_c, ceiling_ft FROM obs",
)
def _(spark, d):
    path = scratch_path(spark, "features-csv")
    obs = S.observations(spark, d).select("event_id", "station", "temperature_c", "ceiling_ft")
    files.save_features(obs, path, "csv")
    return files.load_features(spark, path, "csv", obs.schema)


@query(
    "sampling_windows_from_file",
    "S-10",
    f"SELECT station AS airport, window_start AS \"start\", window_end AS \"end\", {r('duration_hours')} AS duration_hours FROM windows",
)
def _(spark, d):
    from aerogrid.operators import filters, intervals

    path = scratch_path(spark, "windows")
    made = intervals.sampling_windows(filters.usable_intervals(S.intervals(spark, d)))
    made.select(
        F.col("station").alias("airport"),
        F.col("window_start").alias("start"),
        F.col("window_end").alias("end"),
        F.col("start_time").alias("regulation_start"),
        F.col("end_time").alias("regulation_end"),
        "reason",
        "duration_hours",
    ).write.option("header", True).csv(path)
    read = files.read_windows(spark, path)
    return read.select("airport", "start", "end", rnd("duration_hours").alias("duration_hours"))


@query(
    "store_and_load_results",
    "S-11",
    f"""SELECT CAST(trial_id AS VARCHAR) AS model_id, experiment AS experiment_id, {r('score')} AS score, {r('f1')} AS f1, time_s AS training_time, error FROM trials""",
)
def _(spark, d):
    path = scratch_path(spark, "results")
    t = S.trials(spark, d)
    rows = t.select(
        F.col("trial_id").cast("string").alias("model_id"),
        F.col("experiment").alias("experiment_id"),
        "model",
        F.lit("classifier").alias("model_type"),
        F.col("stored_on").cast("timestamp_ntz").alias("stored_at"),
        F.create_map(F.lit("score"), "score", F.lit("f1"), "f1").alias("metrics"),
        F.array(F.array(F.col("trial_id"), F.lit(0).cast("long"))).alias("confusion"),
        F.array(F.struct(F.col("model").alias("feature"), F.col("score").alias("importance"))).alias("importances"),
        F.create_map(F.lit("type"), "experiment").alias("config"),
        F.col("time_s").alias("training_time"),
        "error",
    )
    results.append_results(rows.where(F.col("error").isNull()), path)
    results.append_results(rows.where(F.col("error").isNotNull()), path)
    stored = results.load_results(spark, path)
    return stored.select(
        "model_id",
        "experiment_id",
        rnd(F.col("metrics")["score"]).alias("score"),
        rnd(F.col("metrics")["f1"]).alias("f1"),
        "training_time",
        "error",
    )


def _exported(name, fmt):
    @query(name, "S-12", f"SELECT trial_id, model, experiment, {r('score')} AS score FROM trials")
    def _(spark, d):
        path = scratch_path(spark, "export")
        rows = S.trials(spark, d).select("trial_id", "model", "experiment", "score")
        results.export_results(rows, path, fmt)
        reader = spark.read.schema(rows.schema)
        read = reader.json(path) if fmt == "json" else reader.option("header", True).csv(path)
        return read.select("trial_id", "model", "experiment", rnd("score").alias("score"))


_exported("export_comparison", "json")
_exported("export_comparison_csv", "csv")


_SCALED = ("visibility_m", "ceiling_ft", "wind_speed_kt", "temperature_c", "dewpoint_c")


@query(
    "scaled_and_encoded_blocks",
    "S-16",
    f"""WITH l AS (SELECT event_id, station, ts, CASE WHEN visibility_m = 9999 THEN 10000 ELSE visibility_m END AS visibility_m,
 CASE WHEN ceiling_ft IS NULL THEN 0 WHEN event_id % 5 = 0 THEN 2 WHEN event_id % 2 = 0 THEN 3 ELSE 4 END AS cover,
 CASE WHEN ceiling_ft IS NULL THEN 5000 WHEN event_id % 5 = 0 THEN floor(ceiling_ft / 50) * 100 ELSE floor(ceiling_ft / 100) * 100 END AS ceiling_ft,
 CASE WHEN event_id % 17 = 0 THEN 0 ELSE wind_speed_kt END AS wind_speed_kt, CASE WHEN event_id % 17 <> 0 AND event_id % 11 <> 0 THEN wind_direction END AS wd,
 CASE WHEN event_id % 13 <> 0 THEN {_AWAY.format(c="temperature_c")} END AS t, CASE WHEN event_id % 13 <> 0 THEN {_AWAY.format(c="dewpoint_c")} END AS dp FROM obs),
 f AS (SELECT *, coalesce(last_value(t IGNORE NULLS) OVER back, first_value(t IGNORE NULLS) OVER ahead) AS temperature_c,
  coalesce(last_value(dp IGNORE NULLS) OVER back, first_value(dp IGNORE NULLS) OVER ahead) AS dewpoint_c,
  coalesce(wd, (SELECT wd FROM l WHERE wd IS NOT NULL GROUP BY wd ORDER BY count(*) DESC, wd LIMIT 1)) AS v FROM l
  WINDOW back AS (PARTITION BY station ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
   ahead AS (PARTITION BY station ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 m AS (SELECT {", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in _SCALED)} FROM f)
SELECT event_id, station, ts, {", ".join(f"{r(f'({c} - lo_{c}) / (hi_{c} - lo_{c})')} AS {c}" for c in _SCALED)},
 {", ".join(f"CAST(v > {lo} AND v <= {hi} AS INTEGER) AS wind_{i}" for i, (lo, hi) in enumerate([(0, 90), (90, 180), (180, 270), (270, 359)], 1))},
 {", ".join(f"CAST(cover = {i} AS INTEGER) AS cover_{i}" for i in range(5))} FROM f, m""",
)
def _(spark, d):
    out = facades.scaled_blocks(S.raw_reports(spark, d))
    return out.withColumns({c: rnd(c) + F.lit(0.0) for c in _SCALED})


_KEPT = ("has_regulation", "regulation_severity", "visibility_m", "temperature_c", "vis_category")
_TWICE = "CAST(ts AS DATE) >= DATE '2024-01-20'"


@query(
    "stored_feature_matrix",
    "S-16 S-14",
    f"""SELECT station, ts, CAST(ts AS DATE) AS "day", has_regulation + CASE WHEN {_TWICE} THEN 10 ELSE 0 END AS has_regulation, regulation_severity,
 visibility_m, temperature_c, vis_category FROM ({join_queries.FEATURE_MATRIX_SQL}) WHERE CAST(ts AS DATE) >= DATE '2024-01-31' - 21""",
)
def _(spark, d):
    """Report files to a stored matrix: a first run over all days, a second that replaces the later ones, then retention."""
    root = scratch_path(spark, "matrix")
    made = settle_by_column(join_queries.feature_matrix(spark, d).select("station", "ts", *_KEPT))
    storage.store_days(made, root)
    storage.store_days(made.where(F.expr(_TWICE)).withColumn("has_regulation", F.col("has_regulation") + 10), root)
    storage.retain_days(spark, root, "2024-01-31", 21)
    read = storage.load_days(spark, root)
    return read.withColumns({c: rnd(c) + F.lit(0.0) for c in ("visibility_m", "temperature_c")})


@query(
    "days_past_retention",
    "S-14",
    "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS removed_day FROM obs WHERE CAST(ts AS DATE) < DATE '2024-01-20' - 10 GROUP BY 1",
)
def _(spark, d):
    root = scratch_path(spark, "days")
    storage.store_days(S.observations(spark, d).select("event_id", "ts"), root)
    return spark.createDataFrame([(x,) for x in storage.retain_days(spark, root, "2024-01-20", 10)], "removed_day string")
