"""The skew-safe forms agree with the plain ones and with brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerogrid.operators import balance, grid, ordering, windows
from aerogrid.sources import standins as S
from tests.helpers import same


@pytest.fixture(scope="module")
def obs(spark, sf_dir):
    return S.observations(spark, sf_dir)


def test_lags_and_rolling_agree(obs, small_blocks):
    for make in (
        lambda s: windows.with_lags(obs, ["temperature_c", "ceiling_ft"], keep=["event_id"], strategy=s),
        lambda s: windows.with_rolling(
            obs, ["visibility_m"], (3, 24), ("min", "max", "median"), keep=["event_id"], strategy=s
        ),
        lambda s: grid.fill_both_ways(obs.select("event_id", "station", "ts", "wind_gust_kt"), 2, ["wind_gust_kt"], tie="event_id", strategy=s),
    ):
        same(make("plain"), make("blocked"))


def test_auto_takes_blocks_when_a_series_is_large(obs, small_blocks):
    out = windows.with_lags(obs, ["temperature_c"], [1], keep=["event_id"])
    assert "_block" in out._jdf.queryExecution().optimizedPlan().toString()


def test_fill_series_agrees(obs, small_blocks):
    sparse = obs.select(
        "event_id", "station", "ts", F.when(F.col("event_id") % 83 == 40, F.col("pressure_hpa")).alias("x")
    )
    for backward in (True, False):
        same(
            ordering.fill_series(sparse, ["x"], strategy="plain", backward=backward),
            ordering.fill_series(sparse, ["x"], strategy="blocked", backward=backward),
        )


def test_seasonal_blocks_agree(obs, small_blocks):
    def made(strategy):
        out = windows.seasonal_decompose(obs, "temperature_c", strategy=strategy)
        keep = ["temperature_c_trend", "temperature_c_seasonal", "temperature_c_residual"]
        return out.select("event_id", *[F.round(c, 6).alias(c) for c in keep])

    same(made("plain"), made("blocked"))


def test_positions_with_a_third_of_rows_at_one_time(spark, small_blocks):
    """One station and one moment hold a third of all rows; the ties are cut by the key."""
    rows = spark.range(900).selectExpr(
        "id AS event_id",
        "CASE WHEN id % 2 = 0 THEN 'A' WHEN id % 5 = 0 THEN NULL ELSE 'B' END AS station",
        "CAST(timestamp_seconds(CASE WHEN id % 3 = 0 THEN 1000000 ELSE 1000000 + id * 600 END) AS TIMESTAMP_NTZ) AS ts",
    )
    got = ordering.positions(rows, ["station"], "ts", "event_id").toPandas()
    assert len(got) == 900
    for _, part in got.groupby("station", dropna=False):
        part = part.sort_values(["ts", "event_id"])
        assert part["_pos"].tolist() == list(range(len(part)))


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([np.round(rng.normal(size=400), 2), np.full(200, 0.5)])
    df = spark.createDataFrame([(int(i % 3), float(v)) for i, v in enumerate(values)], "g int, x double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 1.0]
    for parts in (2, 7, 50):
        row = ordering.exact_quantiles(df, ["x"], probs, parts=parts).first()
        assert np.allclose([row[f"q{i}"] for i in range(6)], np.quantile(values, probs))
    for r in ordering.exact_quantiles(df, ["x"], probs, ["g"], parts=5).collect():
        assert np.allclose([r[f"q{i}"] for i in range(6)], np.quantile(values[r["g"] :: 3], probs))


def test_running_totals_match_cumsum(spark):
    rng = np.random.default_rng(4)
    values = rng.integers(0, 60, 500)
    df = spark.createDataFrame([(int(v), 1) for v in values], "x int, n int")
    cells = np.bincount(values, minlength=60)
    for descending in (False, True):
        got = {r["x"]: r["n_cum"] for r in ordering.running_totals(df, [], "x", ["n"], 9, descending).collect()}
        for v in np.unique(values):
            assert got[v] == (cells[v:].sum() if descending else cells[: v + 1].sum())


def test_hash_ranks_are_dense_and_repeatable(spark):
    df = spark.range(700).selectExpr("id", "id % 3 = 0 AS g")
    got = ordering.hash_ranks(df, ["g"], ["id"], 42).toPandas()
    for _, part in got.groupby("g"):
        assert sorted(part["_rank"]) == list(range(1, len(part) + 1))
        assert (part["_rank_n"] == len(part)).all()
    again = ordering.hash_ranks(df.repartition(7), ["g"], ["id"], 42).toPandas()
    assert dict(zip(got["id"], got["_rank"])) == dict(zip(again["id"], again["_rank"]))


def test_chronological_split_sizes(obs):
    n = obs.count()
    got = {r["split"]: r["count"] for r in balance.chronological_split(obs, [0.85, 0.82], ["train", "val", "test"]).groupBy("split").count().collect()}
    assert got == {"train": int(int(n * 0.85) * 0.82), "val": int(n * 0.85) - int(int(n * 0.85) * 0.82), "test": n - int(n * 0.85)}


def test_sequences_of_short_series(spark):
    df = spark.createDataFrame(
        [("A", i, float(i), i % 2) for i in range(3)], "station string, event_id long, x double, y int"
    ).withColumn("ts", F.expr("CAST(timestamp_seconds(event_id * 60) AS TIMESTAMP_NTZ)"))
    one_step = windows.sequences(df, ["x"], "y", 5, inclusive=False).collect()
    assert sorted(r["sequence"][0][0] for r in one_step) == [0.0, 1.0, 2.0]
    exact = windows.sequences(df, ["x"], "y", 3).collect()
    assert [r["sequence"] for r in exact] == [[[0.0], [1.0], [2.0]]]


def test_value_ranges_follow_the_rows(spark):
    """More rows give more ranges, so none outgrows a task; the results stay exact."""
    rows = spark.range(40_000).selectExpr("CAST(id * 7919 % 40009 AS DOUBLE) AS x")
    assert ordering.range_count(rows) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set(ordering.RANGE_ROWS, "500")
    try:
        assert ordering.range_count(rows) == 80
        totals = ordering.running_totals(rows.withColumn("n", F.lit(1)), [], "x", ["n"]).collect()
        assert [r["n_cum"] for r in sorted(totals, key=lambda r: r["x"])] == list(range(1, 40_001))
    finally:
        spark.conf.unset(ordering.RANGE_ROWS)
