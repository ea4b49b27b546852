"""Small tables worked out by hand for the awkward rules."""

import math

import pytest
from pyspark.sql import functions as F

from aerogrid.functions import text as T
from aerogrid.functions import timefeat as D
from aerogrid.functions import weather as M
from aerogrid.operators import drift, prep, quality, results, windows
from aerogrid.sources import files
from tests.helpers import at


def one(spark, expression, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "value, wanted", [(0.0, None), (0.5, "very_poor"), (1000.0, "very_poor"), (1000.1, "poor"), (10000.0, "good"), (10001.0, "excellent"), (None, None)]
)
def test_visibility_bins_are_right_closed(spark, value, wanted):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(M.visibility_category("v").alias("x")).first()["x"] == wanted


def test_wind_edges(spark):
    df = spark.createDataFrame([("000",), ("360",), ("090",), ("091",), ("VRB",), ("090",)], "w string")
    got = prep.wind_quadrants(df, "w", "q").orderBy("w").collect()
    by = {r["w"]: [r[f"q_{i}"] for i in range(1, 5)] for r in got}
    assert by["000"] == by["360"] == [0, 0, 0, 0]
    assert by["090"] == [1, 0, 0, 0] and by["091"] == [0, 1, 0, 0]
    assert by["VRB"] == [1, 0, 0, 0]  # takes the most frequent direction


def test_half_even_rounding(spark):
    times = ["2024-01-01T00:15:00", "2024-01-01T00:45:00", "2024-01-01T00:16:00", "2024-01-01T01:15:00"]
    df = spark.createDataFrame([(at(t),) for t in times], "ts timestamp_ntz")
    got = [r["x"].isoformat()[11:16] for r in df.select(D.round_time("ts", 30).alias("x")).collect()]
    assert got == ["00:00", "01:00", "00:30", "01:00"]


def test_missing_values_fail_comparisons(spark):
    df = spark.createDataFrame([(None, None)], "v double, c double")
    row = df.select(
        M.flight_category("c", "v").alias("a"), M.flight_category_code("v", "c").alias("b"), M.report_severity("v", "c", "v").alias("s")
    ).first()
    assert tuple(row) == ("unknown", 1, 0)


def test_lag_golden(spark):
    df = spark.createDataFrame([("A", i, float(i)) for i in range(1, 11)], "station string, event_id long, value double")
    df = df.withColumn("ts", F.expr("CAST(timestamp_seconds(event_id * 3600) AS TIMESTAMP_NTZ)"))
    got = windows.with_lags(df, ["value"], [1, 2]).orderBy("event_id").collect()
    assert got[3]["value_lag_1"] == 3 and got[3]["value_lag_2"] == 2 and got[0]["value_lag_1"] is None


def test_constant_window_moments(spark):
    df = spark.createDataFrame([("A", i, 5.0) for i in range(4)], "station string, event_id long, x double")
    df = df.withColumn("ts", F.expr("CAST(timestamp_seconds(event_id) AS TIMESTAMP_NTZ)"))
    last = windows.with_rolling(df, ["x"], [4], ("skew", "kurt", "zscore")).orderBy(F.desc("event_id")).first()
    assert (last["x_roll_skew_4"], last["x_roll_kurt_4"], last["x_roll_zscore_4"]) == (0.0, -3.0, 0.0)


def test_first_cause_wins(spark):
    texts = ["RAIN and fog", "L.V.P. in force", "lxvxpx", "strong wind, snow", "ice on runway", None, "staff"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["x"] for r in df.select(T.cause_class("t").alias("x")).collect()]
    assert got == ["CB", "VISIBILITY/CEILING", "OTHER", "WIND", "SNOW/ICE", "OTHER", "OTHER"]


def test_report_decoding(spark):
    text = "METAR EGLL 010020Z 24015G25KT 210V270 4000 BR FEW004 BKN012 OVC030 M01/M03 Q0998"
    df = spark.createDataFrame([(text,), ("METAR EGLL 010050Z /////KT 9999 Q1013",)], "r string")
    full, bare = df.select(*T.decode_report("r")).collect()
    assert full.asDict() == {
        "wind_direction": 240.0,
        "wind_speed_kt": 15.0,
        "wind_gust_kt": 25.0,
        "visibility_m": 4000.0,
        "ceiling_ft": 1200.0,
        "temperature_c": -1.0,
        "dewpoint_c": -3.0,
        "pressure_hpa": 998.0,
    }
    assert bare["wind_speed_kt"] is None and bare["ceiling_ft"] is None
    legacy = df.select(*T.legacy_fields("r")).collect()
    assert (legacy[0]["ceiling_cover"], legacy[0]["ceiling_ft"]) == (4, 3000.0)  # the last layer wins
    assert tuple(legacy[1])[:5] == (10000.0, 0, 5000.0, 0.0, "No info")


REPORTS = {  # report: (direction, speed, gust, visibility, ceiling, temperature, dewpoint, pressure)
    "METAR EDDF 010020Z 24008MPS CAVOK 05/M02 Q1021 NOSIG": (240.0, 8 * 1.9438444924, None, 10000.0, None, 5.0, -2.0, 1021.0),
    "METAR KJFK 010051Z 31015G22KT 1 1/2SM BR OVC004 09/08 A2992 RMK AO2 BKN001": (310.0, 15.0, 22.0, 1.5 * 1609.344, 400.0, 9.0, 8.0, 2992 * 0.338638866667),
    "METAR KBOS 010054Z 00000KT 10SM FEW250 M12/M20 A3041": (0.0, 0.0, None, 10 * 1609.344, None, -12.0, -20.0, 3041 * 0.338638866667),
    "METAR KSEA 010053Z VRB03KT M1/4SM FG VV002 07/07 A2980": (None, 3.0, None, 0.25 * 1609.344, 200.0, 7.0, 7.0, 2980 * 0.338638866667),
    "METAR LFPG 010030Z AUTO /////KT //// // ////// //// Q////": (None,) * 8,
    "METAR UUEE 010030Z 18005G11MPS 0600NDV FG VV/// 02/// Q0990": (180.0, 5 * 1.9438444924, 11 * 1.9438444924, 600.0, None, 2.0, None, 990.0),
    "METAR EGLL 010020Z 240P99KT 9999 BKN012 10/ Q1000 TEMPO 0400 FG OVC001": (240.0, 99.0, None, 9999.0, 1200.0, 10.0, None, 1000.0),
    "METAR ZBAA 010030Z 02036KMH 3000 SCT010 OVC020 M01/M03 Q1030 BECMG 24010KT 9999": (20.0, 36 * 0.5399568035, None, 3000.0, 2000.0, -1.0, -3.0, 1030.0),
    "": (None,) * 8,
    None: (None,) * 8,
}


def test_every_report_group(spark):
    df = spark.createDataFrame([(t,) for t in REPORTS], "r string").select("r", *T.decode_report("r"))
    for row in df.collect():
        want = REPORTS[row[0]]
        assert [x is None for x in row[1:]] == [x is None for x in want], row
        assert all(abs(a - b) < 1e-9 for a, b in zip(row[1:], want) if b is not None), row


def test_file_names(spark):
    names = ["x_20240105.csv", "2024-02-01.csv", "a_2024_01_31.csv", "x_20249950.csv", "plain.csv"]
    df = spark.createDataFrame([(f"/d/EGLL/{n}",) for n in names], "p string")
    kept = [r["p"][8:] for r in df.where(files.in_name_range("p", "2024-01-01", "2024-01-31")).collect()]
    assert kept == ["x_20240105.csv", "a_2024_01_31.csv", "x_20249950.csv"]


def test_time_range_predicate_reaches_the_scan(spark, sf_dir):
    from aerogrid.operators.filters import filter_dates
    from aerogrid.sources import standins as S

    plan = filter_dates(S.observations(spark, sf_dir), "ts", "2024-01-05", "2024-01-06").select("ts")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in text and "LessThanOrEqual(ts" in text
    assert "ReadSchema: struct<ts:timestamp_ntz>" in text


def test_derivation_of_p_values():
    assert drift.chi2_p_value(16.919, 9) == pytest.approx(0.05, abs=1e-4)
    assert drift.chi2_p_value(18.307, 10) == pytest.approx(0.05, abs=1e-4)
    assert drift.ks_p_value(1.3581 / math.sqrt(5000), 10000, 10000) == pytest.approx(0.05, abs=1e-3)


def test_drift_is_found(spark):
    ref = spark.range(500).selectExpr("CAST(id % 50 AS DOUBLE) AS a", "CAST(id % 30 AS DOUBLE) AS b")
    cur = spark.range(500).selectExpr("CAST(id % 50 + 10 AS DOUBLE) AS a", "CAST(id % 30 AS DOUBLE) AS b")
    got = {r["feature"]: r for r in drift.drift_report(ref, cur, ["a", "b"]).collect()}
    assert got["a"]["drifted"] and not got["b"]["drifted"] and got["a"]["overall_drift"]
    assert got["a"]["ks"] == pytest.approx(0.2)


def test_invalid_weather_is_reported(spark):
    df = spark.createDataFrame([(-100.0, -5.0, -1000.0)], "temperature double, wind_speed double, visibility double")
    found = {(r["check"], r["column"]): r["n"] for r in quality.check_constraints(df, quality.WEATHER_RULES).collect()}
    assert found[("below_min", "temperature")] == found[("below_min", "wind_speed")] == found[("below_min", "visibility")] == 1


def test_constant_columns_do_not_divide_by_zero(spark):
    from aerogrid.operators import selection

    df = spark.createDataFrame([(1.0, 0), (1.0, 1), (1.0, 1)], "x double, y int")
    assert selection.anova_f(df, ["x"], "y").first()["score"] is None
    scaled = prep.Scaler("standard").fit(df, ["x"]).transform(df)
    assert {r["x"] for r in scaled.collect()} == {0.0}


def test_retention(spark):
    df = spark.createDataFrame([(1, at("2024-01-01").date()), (2, at("2024-03-01").date())], "id int, day date")
    kept, removed = results.split_retention(df, "day", "2024-03-05", 30)
    assert [r["id"] for r in kept.collect()] == [2] and [r["id"] for r in removed.collect()] == [1]
