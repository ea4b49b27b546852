"""Limited fills look up near rows one by one, and give what frames give."""

import random

import pytest
from pyspark.sql import functions as F

from aerogrid.operators import grid


def series():
    rng = random.Random(4)
    values = [rng.choice([None, None, None, float("nan"), rng.random()]) for _ in range(300)]
    return [(s, i, v) for s in ("A", None) for i, v in enumerate(values[:150] if s else values)]


def expected(rows, limit, ahead):
    out = {}
    for s in {r[0] for r in rows}:
        own = [v for t, _, v in sorted(rows, key=lambda r: r[1]) if t == s]
        for i in range(len(own)):
            near = [*own[max(0, i - limit) : i + 1][::-1], *(own[i : i + limit + 1] if ahead else [])]
            out[s, i] = str(next((v for v in near if v is not None), None))
    return out


def filled(spark, rows, limit, ahead):
    table = spark.createDataFrame(rows, "station string, at int, v double").withColumn("ts", F.timestamp_seconds(F.col("at") * 1800).cast("timestamp_ntz"))
    return grid.fill_both_ways(table, limit, ["v"]) if ahead else grid.forward_fill(table, limit, ["v"])


@pytest.mark.parametrize("ahead", [False, True])
@pytest.mark.parametrize("limit", [0, 1, 2, 6])
def test_fills_reach_as_far_as_their_limit(spark, limit, ahead):
    rows = series()
    got = {(r["station"], r["at"]): str(r["v"]) for r in filled(spark, rows, limit, ahead).collect()}
    assert got == expected(rows, limit, ahead)


def test_fills_across_blocks(spark, small_blocks):
    rows = [r for r in series() if r[0]]
    got = {(r["station"], r["at"]): str(r["v"]) for r in filled(spark, rows, 2, True).collect()}
    assert got == expected(rows, 2, True)


def test_near_rows_need_no_sliding_frame(spark):
    plan = filled(spark, series(), 2, True)._jdf.queryExecution().optimizedPlan().toString()
    assert "lag(" in plan and "lead(" in plan and "last(" not in plan and "first(" not in plan
