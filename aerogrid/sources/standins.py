"""Observation, interval, forecast, text and result views derived from the given tables.

Every view is a lazy projection (or small aggregation) of one or two parquet tables, so work grows with
the tables.  `aerogrid.plans.oracle_views` states the same derivations in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from aerogrid.functions.timefeat import floor_time
from aerogrid.sources.files import canonical_intervals

STATIONS = ["EGLL", "LSZH", "LFPG", "LOWW"]  # names of users 0 to 3; the others get four letters by number
REASONS = [
    "W - Weather",
    "G - Aerodrome Capacity",
    "Thunderstorms CB",
    "Low visibility FOG",
    "T - Equipment Terminal",
    "S - Staffing",
    None,
    "Strong WIND",
]  # fixed values: k % 8
CAUSES = [
    "CB in area",
    "heavy rain and showers",
    "low visibility procedures",
    "strong wind",
    "fog",
    "snow and icing",
    None,
]  # fixed values: doc_id % 7


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read a table; its schema is taken from the file footer once per path and given afterwards."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _pick(index: str, values: list) -> str:
    arms = " ".join(f"WHEN {i} THEN " + ("CAST(NULL AS STRING)" if v is None else f"'{v}'") for i, v in enumerate(values))
    return f"CASE {index} {arms} END"


def _station(number: str) -> str:
    """One station per number: a known name or four letters."""
    letters = ", ".join(f"char(65 + {number} DIV {26**i} % 26)" for i in (3, 2, 1, 0))
    return f"coalesce({_pick(number, STATIONS)}, concat({letters}))"


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "ts",
        "event_type",
        f"{_station('user_id')} AS station",
        "CAST(round(value * 100) AS BIGINT) AS vc",
        "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k",
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation per event: station, time and the decoded weather values."""
    temp = "round(CAST(k AS DOUBLE) * 0.4D - 10D, 1)"
    return _base(spark, sf_dir).selectExpr(
        "event_id",
        "ts",
        "station",
        f"{temp} AS temperature_c",
        f"round({temp} - CAST(vc % 120 AS DOUBLE) / 10D, 1) AS dewpoint_c",
        "CAST(vc % 45 AS DOUBLE) AS wind_speed_kt",
        "CAST((vc * 7) % 361 AS DOUBLE) AS wind_direction",
        "CASE WHEN vc % 3 = 0 THEN CAST(vc % 45 + vc % 15 AS DOUBLE) END AS wind_gust_kt",
        """CASE WHEN event_type = 'error' THEN CAST((vc % 20) * 100 AS DOUBLE)
           ELSE CAST(least(9999, 1000 + (vc % 100) * 100) AS DOUBLE) END AS visibility_m""",
        "CASE WHEN k % 10 <> 0 THEN CAST(k * 50 AS DOUBLE) END AS ceiling_ft",
        "round(980D + CAST(k AS DOUBLE) * 0.7D, 1) AS pressure_hpa",
    )


OBS_NUMERIC = [
    "temperature_c",
    "dewpoint_c",
    "wind_speed_kt",
    "wind_direction",
    "wind_gust_kt",
    "visibility_m",
    "ceiling_ft",
    "pressure_hpa",
]


def raw_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restriction list with the raw column names of the operational export."""
    start = "timestamp_micros(unix_micros(CAST(ts AS TIMESTAMP)) DIV 60000000 * 60000000)"
    reason = _pick("k % 8", REASONS)
    return (
        _base(spark, sf_dir)
        .where("event_type = 'error'")
        .selectExpr(
            "station AS `Protected Location Id`",
            "CASE WHEN vc % 10 = 9 THEN 'Airspace' ELSE 'Aerodrome' END AS `Protected Location Type`",
            f"CAST({start} AS TIMESTAMP_NTZ) AS `Regulation Start Time`",
            f"CAST({start} AS TIMESTAMP_NTZ) + make_dt_interval(0, 0, 30 + CAST(vc % 240 AS INT)) AS `Regulation End Date`",
            "CASE WHEN k % 4 = 0 THEN 'Cancelled' ELSE 'Applied' END AS `Regulation Cancel Status`",
            f"{reason} AS `Regulation Reason Name`",
            f"concat('due to ', coalesce({reason}, 'unknown')) AS `Regulation Description`",
            "30 + vc % 240 AS `Regulation Duration (min)`",
            "vc % 500 AS `ATFM Delay (min)`",
            "vc % 60 AS `Regulated Traffic`",
            "event_id AS ordinal",
            "vc % 5 AS severity",
        )
    )


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals under library names, with an explicit ordinal and a severity."""
    return canonical_intervals(raw_intervals(spark, sf_dir), extra=["severity", "ordinal"])


def _digits(c: Column, width: int) -> Column:
    return F.lpad(c.cast("long").cast("string"), width, "0")


def _signed(c: Column) -> Column:
    whole = F.floor(F.abs(c) + F.lit(0.5)).cast("long")
    return F.concat(F.when(c < 0, "M").otherwise(""), F.lpad(whole.cast("string"), 2, "0"))


def raw_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """METAR-like report text written from the observations, with date parts as separate columns."""
    obs = observations(spark, sf_dir)
    d = F.col("wind_direction")
    wind = F.when(
        F.col("event_id") % 17 == 0,
        F.lit("/////KT"),
    ).otherwise(
        F.concat(
            F.when(F.col("event_id") % 11 == 0, "VRB").otherwise(_digits(d, 3)),
            _digits(F.col("wind_speed_kt"), 2),
            F.when(F.col("wind_gust_kt").isNotNull(), F.concat(F.lit("G"), _digits(F.col("wind_gust_kt"), 2))).otherwise(
                ""
            ),
            F.lit("KT"),
        )
    )
    clouds = F.when(F.col("ceiling_ft").isNull(), "").otherwise(
        F.concat(
            F.lit(" FEW"),
            _digits(F.floor(F.col("ceiling_ft") / 200), 3),
            F.when(F.col("event_id") % 2 == 0, " BKN").otherwise(" OVC"),
            _digits(F.floor(F.col("ceiling_ft") / 100), 3),
            F.when(F.col("event_id") % 5 == 0, F.concat(F.lit(" SCT"), _digits(F.floor(F.col("ceiling_ft") / 50), 3)))
            .otherwise(""),
        )
    )
    weather = F.when(F.col("visibility_m") < 1000, " FG").when(F.col("wind_speed_kt") > 40, " TSRA").otherwise("")
    temps = F.when(F.col("event_id") % 13 == 0, "").otherwise(
        F.concat(F.lit(" "), _signed(F.col("temperature_c")), F.lit("/"), _signed(F.col("dewpoint_c")))
    )
    kind = F.when(F.col("event_id") % 19 == 0, "SPECI ").otherwise("METAR ")
    return obs.select(
        "event_id",
        "station",
        "ts",
        F.year("ts").alias("year"),
        F.month("ts").alias("month"),
        F.day("ts").alias("day"),
        F.hour("ts").alias("hour"),
        F.minute("ts").alias("minute"),
        F.concat(
            kind,
            F.col("station"),
            F.lit(" "),
            F.date_format("ts", "ddHHmm"),
            F.lit("Z "),
            wind,
            F.lit(" "),
            _digits(F.col("visibility_m"), 4),
            weather,
            clouds,
            temps,
            F.lit(" Q"),
            _digits(F.floor(F.col("pressure_hpa")), 4),
        ).alias("report"),
    )


def mixed_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with the groups of other countries, a kind for each remainder of event_id by 8."""
    kind = F.col("event_id") % 8
    hundreds = _digits(F.floor(F.coalesce(F.col("ceiling_ft"), F.lit(900.0)) / 100), 3)
    wind = F.when(kind == 1, F.concat(_digits(F.col("wind_direction"), 3), _digits(F.floor(F.col("wind_speed_kt") / 2), 2), F.lit("MPS")))
    wind = wind.when(kind == 6, F.lit("/////KT")).otherwise(F.concat(_digits(F.col("wind_direction"), 3), _digits(F.col("wind_speed_kt"), 2), F.lit("KT")))
    sky = F.when(kind == 2, F.lit("CAVOK")).when(kind == 3, F.concat((F.col("event_id") % 5).cast("string"), F.lit(" 1/2SM BKN"), hundreds))
    sky = sky.when(kind == 5, F.concat(_digits(F.col("visibility_m"), 4), F.lit(" FG VV"), hundreds)).when(kind == 6, F.lit("//// // ///"))
    sky = sky.otherwise(F.concat(_digits(F.col("visibility_m"), 4), F.lit(" SCT001 OVC"), hundreds))
    temps = F.when(kind == 6, F.lit("/////")).when(kind == 4, F.concat(_signed(F.col("temperature_c")), F.lit("///")))
    temps = temps.otherwise(F.concat(_signed(F.col("temperature_c")), F.lit("/"), _signed(F.col("dewpoint_c"))))
    pressure = F.when(kind == 4, F.concat(F.lit("A"), _digits(F.floor(F.col("pressure_hpa") * 3), 4))).otherwise(F.concat(F.lit("Q"), _digits(F.floor(F.col("pressure_hpa")), 4)))
    later = F.when(kind == 7, F.lit(" TEMPO 36099MPS 0200 OVC000 RMK A1234 VV000")).otherwise("")
    head = F.concat(F.lit("METAR "), F.col("station"), F.lit(" "), F.date_format("ts", "ddHHmm"), F.lit("Z"))
    return observations(spark, sf_dir).select("event_id", F.concat(F.concat_ws(" ", head, wind, sky, temps, pressure), later).alias("report"))


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One forecast per station and 6 hours, valid for 9 hours, so neighbours overlap."""
    obs = observations(spark, sf_dir)
    slot = floor_time("ts", 360)
    first = F.min_by(
        F.struct("wind_speed_kt", "wind_direction", "visibility_m", "ceiling_ft"), F.struct("ts", "event_id")
    )
    return (
        obs.groupBy("station", slot.alias("issue_time"))
        .agg(first.alias("f"))
        .select(
            "station",
            "issue_time",
            F.col("issue_time").alias("valid_from"),
            (F.col("issue_time") + F.expr("INTERVAL 9 HOURS")).alias("valid_to"),
            "f.*",
        )
    )


def raw_forecast_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TAF-like text written from the forecasts: a main period and one change group."""
    f = forecasts(spark, sf_dir)
    span = F.concat(F.date_format("valid_from", "ddHH"), F.lit("/"), F.date_format("valid_to", "ddHH"))
    wind = lambda plus: F.concat(
        _digits(F.col("wind_direction"), 3),
        _digits(F.col("wind_speed_kt") + plus, 2),
        F.lit("G"),
        _digits(F.col("wind_speed_kt") + plus + 9, 2),
        F.lit("KT"),
    )
    return f.select(
        "station",
        "issue_time",
        "valid_from",
        "valid_to",
        F.concat(
            F.lit("TAF "),
            "station",
            F.lit(" "),
            F.date_format("issue_time", "ddHHmm"),
            F.lit("Z "),
            span,
            F.lit(" "),
            wind(0),
            F.lit(" "),
            _digits(F.col("visibility_m"), 4),
            F.when(F.col("ceiling_ft").isNull(), "").otherwise(
                F.concat(F.lit(" BKN"), _digits(F.floor(F.col("ceiling_ft") / 100), 3))
            ),
            F.lit(" TEMPO "),
            span,
            F.lit(" "),
            wind(5),
            F.lit(" 3000"),
        ).alias("report"),
    )


def causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text causes: the whole document text behind a keyword phrase; one in seven is missing."""
    phrase = F.expr(_pick("doc_id % 7", CAUSES))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.expr(_station("(doc_id DIV 10)")).alias("station"),
        F.concat(phrase, F.lit(" "), F.col("text")).alias("description"),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four numeric features and a binary target, one row per line item."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        "l_shipdate",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        (F.col("l_tax") + F.lit(0.0)).alias("l_tax"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
    )


FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of two models with many ties."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("model"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
        (F.col("l_discount") * 10.0).alias("score"),
        F.col("l_orderkey").alias("row_key"),
    )


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True and predicted class from the label table."""
    return table(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").cast("int").alias("y"), F.col("toxic").cast("int").alias("yhat")
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored results: model, experiment, score, time, error, and the day they were stored."""
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        p.alias("trial_id"),
        F.col("p_brand").alias("model"),
        F.col("p_type").alias("experiment"),
        F.when(p % 17 != 0, F.col("p_retailprice") / 2000.0).alias("score"),
        F.when(p % 17 != 0, (p * 7 % 1000).cast("double") / 1000.0).alias("f1"),
        F.col("p_size").cast("double").alias("time_s"),
        F.when(p % 17 == 0, F.lit("failed to fit")).alias("error"),
        F.date_add(F.lit("2024-01-01").cast("date"), (p % 90).cast("int")).alias("stored_on"),
    )


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categorical columns with a binary target: orders joined to their customers."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        "o_orderkey",
        "o_orderpriority",
        "o_orderstatus",
        "c_mktsegment",
        "o_totalprice",
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"),
    )
