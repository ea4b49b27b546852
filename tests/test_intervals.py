"""Interval labels against brute force, at the bounds, and in all forms."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerogrid.operators import grid, intervals
from aerogrid.operators.intervals import ACTIVE, Measure
from tests.helpers import at, rows_of

POINT = "station string, event_id long, ts timestamp_ntz"
SPAN = "station string, ordinal long, start_time timestamp_ntz, end_time timestamp_ntz, severity int"
T0 = at("2024-01-01 00:00:00")


def minute(m):
    return T0 + dt.timedelta(minutes=int(m))


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    spans = []
    for i in range(150):
        start = int(rng.integers(0, 3000))
        length = int(rng.choice([0, 1, 30, 120, 2500]))
        spans.append(("A" if i % 3 else "B", i, minute(start), minute(start + length), int(rng.integers(0, 5))))
    spans += [("A", 200 + i, minute(500), minute(900), 4) for i in range(60)]  # copies
    points = [("A" if i % 2 else "B", i, minute(rng.integers(0, 3200))) for i in range(600)]
    points += [("A", 1000 + i, minute(700)) for i in range(300)]  # a third at one moment
    return points, spans


def brute(points, spans, closed):
    out = {}
    for s, i, t in points:
        hits = [x for x in spans if x[0] == s and x[2] <= t and (t <= x[3] if closed else t < x[3])]
        out[i] = (len(hits) or None, max((x[4] for x in hits), default=None), max((x[1] for x in hits), default=None))
    return out


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("strategy", ["broadcast", "sorted", "auto"])
def test_points_match_brute_force(spark, data, strategy, closed):
    points, spans = data
    measures = [Measure("n", "sum", "1"), Measure("severity", "max", "severity"), Measure("last", "max", "ordinal")]
    got = intervals.label_points(
        spark.createDataFrame(points, POINT), spark.createDataFrame(spans, SPAN), measures, closed, strategy=strategy
    ).collect()
    assert len(got) == len(points)
    assert {r["event_id"]: (r["n"], r["severity"], r["last"]) for r in got} == brute(points, spans, closed)


def test_large_step_function_is_not_broadcast(spark, data, monkeypatch):
    monkeypatch.setattr(intervals, "BROADCAST_HOURS", 10)
    points, spans = data
    out = intervals.label_points(spark.createDataFrame(points, POINT), spark.createDataFrame(spans, SPAN), [Measure("n", "sum", "1")], strategy="broadcast")
    assert "BroadcastNestedLoop" not in plan(out) and "BroadcastHashJoin [station" not in plan(out)
    assert {r["event_id"]: r["n"] for r in out.collect()} == {i: v[0] for i, v in brute(points, spans, False).items()}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_steps_are_not_broadcast(spark):
    obs = spark.createDataFrame([("A", minute(0), 1.0), ("B", minute(3000), 2.0)], "station string, ts timestamp_ntz, visibility_m double")
    forecast = spark.createDataFrame([("A", minute(0), minute(0), minute(90), 5.0)], "station string, issue_time timestamp_ntz, valid_from timestamp_ntz, valid_to timestamp_ntz, visibility_m double")
    steps = grid.forecast_on_grid(forecast, ["visibility_m"])
    spans = spark.createDataFrame([("A", 0, minute(0), minute(59), 1)], SPAN)
    joined = grid.join_steps(grid.on_grid(obs), steps, "left")
    labelled = intervals.grid_labels(joined, spans, 30, [ACTIVE])
    assert "BroadcastHashJoin" not in plan(labelled)
    got = {(r["station"], r["ts"]): (r["visibility_m"], r["visibility_m_forecast"], r["active"]) for r in labelled.collect()}
    assert len(got) == 2 * 101
    assert got["A", minute(30)] == (1.0, 5.0, 1) and got["A", minute(120)] == (None, None, None) and got["B", minute(3000)] == (2.0, None, None)


def test_large_placement_and_salting(spark, data, small_blocks, monkeypatch):
    monkeypatch.setattr(intervals, "SMALL_INTERVALS", 10)
    points, spans = data
    got = intervals.label_points(
        spark.createDataFrame(points, POINT), spark.createDataFrame(spans, SPAN), [Measure("n", "sum", "1")]
    ).collect()
    wanted = {i: v[0] for i, v in brute(points, spans, False).items()}
    assert {r["event_id"]: r["n"] for r in got} == wanted


@pytest.mark.parametrize("level", [1, 3])
@pytest.mark.parametrize("strategy", ["broadcast", "sorted"])
def test_long_blocks_are_cut(spark, data, monkeypatch, strategy, level):
    monkeypatch.setattr(intervals, "BLOCK_LEVEL", level)
    points, spans = data
    measures = [Measure("n", "sum", "1"), Measure("severity", "max", "severity"), Measure("last", "max", "ordinal")]
    got = intervals.label_points(spark.createDataFrame(points, POINT), spark.createDataFrame(spans, SPAN), measures, strategy=strategy).collect()
    assert {r["event_id"]: (r["n"], r["severity"], r["last"]) for r in got} == brute(points, spans, False)


def test_a_hot_station_meets_no_large_key(spark, monkeypatch):
    """90 % of the intervals at one station, many of them over all its time: no block key has more positions than the level allows."""
    monkeypatch.setattr(intervals, "SMALL_INTERVALS", 100)
    monkeypatch.setattr(intervals, "BLOCK_LEVEL", 6)
    n = F.col("id")
    start = F.when(n % 5 == 0, n % 7).otherwise(n * 3)
    end = F.when(n % 5 == 0, 40_000 + n).otherwise(n * 3 + 50)
    at_minute = lambda c: F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'") + F.make_dt_interval(mins=c.cast("int"))
    station = F.when(n % 10 < 9, "HOT").otherwise(F.concat(F.lit("S"), n % 3))
    spans = spark.range(6000).select(station.alias("station"), n.alias("ordinal"), at_minute(start).alias("start_time"), at_minute(end).alias("end_time"), (n % 9).cast("int").alias("severity"))
    keys = []
    join = type(spans).join

    def counted(self, other, on=None, how=None):
        if on == ["station", "level", "node"]:
            keys.append(self.groupBy(*on).count().agg(F.max("count")).first()[0])
        return join(self, other, on, how)

    monkeypatch.setattr(type(spans), "join", counted)
    made = intervals.step_function(spans, [Measure("n", "sum", "1")])
    total, covered = made.agg(F.count("*"), F.sum("n")).first()
    assert keys and max(keys) <= 2**6 and total > 9000
    # each interval counts once in every segment between its ends
    monkeypatch.setattr(type(spans), "join", join)
    monkeypatch.setattr(intervals, "BLOCK_LEVEL", 30)
    assert intervals.step_function(spans, [Measure("n", "sum", "1")]).agg(F.count("*"), F.sum("n")).first() == (total, covered)


@pytest.mark.parametrize("bounds", ["closed", "half_open", "overlap"])
def test_grid_matches_brute_force(spark, data, bounds):
    _, spans = data
    step = dt.timedelta(minutes=30)
    steps = [(s, T0 + k * step) for s in "AB" for k in range(110)]
    grid_df = spark.createDataFrame(steps, "station string, ts timestamp_ntz")
    got = intervals.grid_labels(grid_df, spark.createDataFrame(spans, SPAN), 30, [ACTIVE], bounds).collect()

    def hit(x, lo):
        if bounds == "closed":
            return x[2] <= lo <= x[3]
        if bounds == "half_open":
            return x[2] <= lo < x[3]
        return lo <= x[2] < lo + step or x[2] <= lo < x[3]

    wanted = {(s, t): any(x[0] == s and hit(x, t) for x in spans) for s, t in steps}
    assert {(r["station"], r["ts"]): r["active"] == 1 for r in got} == wanted


def test_bounds_at_interval_ends(spark):
    points = spark.createDataFrame([("A", i, minute(m)) for i, m in enumerate((59, 60, 90, 91))], POINT)
    span = spark.createDataFrame([("A", 1, minute(60), minute(90), 1)], SPAN)
    for closed, wanted in ((True, [None, 1, 1, None]), (False, [None, 1, None, None])):
        got = intervals.label_points(points, span, closed=closed).orderBy("event_id").collect()
        assert [r["active"] for r in got] == wanted


def test_last_window_in_file_order_wins(spark):
    windows = spark.createDataFrame(
        [("A", 2, minute(600), minute(660), "x", 60), ("A", 1, minute(720), minute(780), "y", 60)],
        "station string, ordinal long, start_time timestamp_ntz, end_time timestamp_ntz, reason string, duration_min long",
    )
    points = spark.createDataFrame([("A", 0, minute(480)), ("A", 1, minute(610)), ("A", 2, minute(60))], POINT)
    made = intervals.label_with_windows(points, intervals.sampling_windows(windows)).orderBy("event_id").collect()
    assert [r["time_to_regulation"] for r in made] == [2.0, pytest.approx(-10 / 60), None]
    assert [r["has_regulation"] for r in made] == [0, 1, 0]
    assert [r["in_window"] for r in made] == [1, 1, 0]


def test_forecast_alignment(spark):
    rows = spark.createDataFrame(
        [("A", minute(0), minute(10), minute(80), 5.0), ("A", minute(20), minute(30), minute(60), 9.0)],
        "station string, issue_time timestamp_ntz, valid_from timestamp_ntz, valid_to timestamp_ntz, wind_speed_kt double",
    )
    loose = {r["ts"]: r["wind_speed_kt_forecast"] for r in grid.forecast_on_grid(rows, ["wind_speed_kt"]).collect()}
    assert loose == {minute(10): 5.0, minute(40): 5.0, minute(70): 5.0, minute(30): 9.0, minute(60): 9.0}
    fixed = grid.forecast_on_grid(rows, ["wind_speed_kt"], align=True).collect()
    assert {r["ts"]: r["wind_speed_kt_forecast"] for r in fixed} == {minute(0): 5.0, minute(30): 9.0, minute(60): 9.0}


def test_gap_of_one_and_three_steps(spark):
    rows = spark.createDataFrame(
        [("A", 0, minute(0)), ("A", 1, minute(30)), ("A", 2, minute(120))], POINT
    ).withColumn("x", F.col("event_id"))
    got = grid.fill_gaps(rows, ["x"], 30).orderBy("ts").collect()
    assert [(r["ts"], r["x"]) for r in got] == [
        (minute(0), 0),
        (minute(30), 1),
        (minute(60), 1),
        (minute(90), 1),
        (minute(120), 2),
    ]


def test_an_open_ended_interval_is_clipped_to_the_grid(spark):
    obs = spark.createDataFrame([("A", 1, minute(0)), ("B", 2, minute(600))], POINT)
    spans = spark.createDataFrame([("A", 1, minute(90), at("9999-12-31 00:00:00"), 1), ("B", 2, at("1700-01-01 00:00:00"), minute(60), 2)], SPAN)
    steps = grid.time_grid(obs)
    got = intervals.grid_labels(steps, spans, 30, [ACTIVE], "half_open")
    active = {(r["station"], r["ts"]) for r in got.where("active = 1").collect()}
    assert active == {("A", minute(m)) for m in range(90, 601, 30)} | {("B", minute(m)) for m in (0, 30)}


def test_long_segments_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(intervals, "BROADCAST_HOURS", 100)
    points = spark.createDataFrame([("A", i, minute(i * 7)) for i in range(400)], POINT)
    spans = spark.createDataFrame([("A", 1, minute(60), at("2030-01-01 00:00:00"), 1), ("A", 2, minute(500), minute(510), 3)], SPAN)
    labelled = intervals.label_points(points, spans, [ACTIVE])
    assert "BroadcastHashJoin" not in labelled._jdf.queryExecution().executedPlan().toString().split("Window")[0]
    assert labelled.where("active = 1").count() == sum(1 for i in range(400) if i * 7 >= 60)


def test_the_grid_is_dealt_once(spark):
    """Labels and observations come to the steps of a station; no exploded step is shuffled, and the rows are those of the other way."""
    obs = spark.createDataFrame([(f"S{i % 7}", at(f"2024-01-0{1 + i % 3} 0{i % 9}:10:00"), float(i)) for i in range(60)], "station string, ts timestamp_ntz, visibility_m double")
    spans = spark.createDataFrame([(f"S{i}", at(f"2024-01-02 0{i}:00:00"), at(f"2024-01-02 0{i + 2}:30:00")) for i in range(5)], "station string, start_time timestamp_ntz, end_time timestamp_ntz")
    found = []
    for limit in ("1000", "10"):
        spark.conf.set("spark.aerogrid.maxGroupRows", limit)
        try:
            labels = intervals.grid_labels(grid.on_grid(obs), spans, 30, [ACTIVE], "half_open", grid.grid_span(obs))
            found.append(rows_of(labels))
            plan = labels.groupBy("station", "active").count()._jdf.queryExecution().executedPlan().toString()
            top = plan.split("SortMergeJoin")[0]
            assert ("Exchange" in top) == (limit == "10"), plan
        finally:
            spark.conf.unset("spark.aerogrid.maxGroupRows")
    assert found[0] == found[1] and len(found[0][1]) > 500
