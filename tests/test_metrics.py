"""Evaluation and result operators against brute force."""

import numpy as np
import pytest

from aerogrid.operators import balance, metrics, results


def test_golden_metrics(spark):
    rows = list(zip([0, 1, 1, 0, 1], [0, 1, 0, 0, 1], [0.2, 0.7, 0.4, 0.1, 0.8]))
    df = spark.createDataFrame(rows, "y int, yhat int, score double")
    got = metrics.binary_metrics(df).first()
    assert (got["accuracy"], got["precision"]) == (0.8, 1.0) and got["recall"] == pytest.approx(2 / 3)
    assert metrics.roc_auc(df).first()["auc"] == 1.0
    assert metrics.best_threshold(df).first()["threshold"] == 0.25  # the lowest of the best


def test_auc_with_ties_and_one_class(spark):
    rng = np.random.default_rng(5)
    score, y = rng.integers(0, 9, 300) / 8, rng.integers(0, 2, 300)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, score)], "y int, score double")
    pos, neg = score[y == 1], score[y == 0]
    pairs = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
    assert metrics.roc_auc(df).first()["auc"] == pytest.approx(pairs)
    assert metrics.roc_auc(df.where("y = 1")).first()["auc"] is None


def test_votes(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 0, 0)], "a int, b int, c int")
    votes = [F.col(c) for c in "abc"]
    row = df.select(metrics.hard_vote(votes, [2, 1, 1]).alias("tie"), metrics.hard_vote(votes, [3, 1, 1]).alias("win")).first()
    assert (row["tie"], row["win"]) == (0, 1)  # half of the weights is not enough


def test_pareto_front_matches_brute_force(spark):
    rng = np.random.default_rng(6)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.integers(0, 40, (300, 2)))]
    # a curved front, so that it has many points
    pts += [(1000 + i, 40.0 + i, 60.0 - i) for i in range(15)] + [(2000, 45.0, 55.0)]
    df = spark.createDataFrame(pts, "id long, a double, b double")
    beats = lambda p, q: p[1] >= q[1] and p[2] >= q[2] and (p[1] > q[1] or p[2] > q[2])
    wanted = {p[0] for p in pts if not any(beats(q, p) for q in pts)}
    got = results.pareto_front(df, "id", "a", "b").collect()
    assert {r["id"] for r in got} == wanted and len(wanted) > 10
    assert [r["id"] for r in got if r["primary_pick"]] == [1014]


def test_best_so_far(spark):
    scores = [0.2, None, 0.5, 0.1, 0.7]
    df = spark.createDataFrame([("e", i, s) for i, s in enumerate(scores)], "e string, i long, s double")
    got = results.best_so_far(df, ["e"], "i", "s").orderBy("i").collect()
    assert [r["best_so_far"] for r in got] == [0.2, 0.2, 0.5, 0.5, 0.7]


def test_balance_takes_what_is_there(spark):
    rows = [(i, 1, 1) for i in range(100)] + [(100 + i, 0, 1) for i in range(50)] + [(200 + i, 0, 0) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, y int, w int")
    got = {r["stratum"]: r["count"] for r in balance.balance_windows(df, "y", "w", ["id"]).groupBy("stratum").count().collect()}
    assert got == {"positive": 100, "window": 50, "outside": 50}


def test_stratified_folds_are_even(spark):
    df = spark.range(103).selectExpr("id", "CAST(id % 4 = 0 AS INT) AS y")
    sizes = balance.stratified_folds(df, "y", ["id"], 5).groupBy("y", "fold").count().collect()
    for y in (0, 1):
        counts = [r["count"] for r in sizes if r["y"] == y]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1
