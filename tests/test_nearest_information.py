"""Mutual information by nearest rows against brute force over all pairs."""

import numpy as np
from pyspark.sql import functions as F

from aerogrid.operators.selection import digamma, nearest_mutual_information


def plain_digamma(x):
    return -0.5772156649015329 + sum(1 / j for j in range(1, int(x)))


def plain(x, y, k=3):
    keep = [i for i in range(len(x)) if x[i] is not None and y[i] is not None]
    x, y = np.array([x[i] for i in keep], float), np.array([y[i] for i in keep])
    sizes = {c: int((y == c).sum()) for c in set(y.tolist())}
    rows = [i for i in range(len(x)) if sizes[int(y[i])] > 1]
    base = x[rows]
    total = plain_digamma(len(rows))
    for i in rows:
        own = np.sort(np.abs(np.delete(x, i)[np.delete(y, i) == y[i]] - x[i]))
        n = min(k, len(own))
        r = own[n - 1]
        m = ((base > x[i] - r) & (base < x[i] + r)).sum() if r > 0 else (base == x[i]).sum()
        total += (plain_digamma(n) - plain_digamma(sizes[int(y[i])]) - plain_digamma(m)) / len(rows)
    return max(0.0, total)


def test_equal_to_brute_force(spark):
    rng = np.random.default_rng(2)
    n = 300
    y = [int(v) for v in rng.integers(0, 3, n)]
    near = [float(v + 2 * c) for v, c in zip(rng.normal(size=n), y)]
    tied = [float(v // 3 + c) for v, c in zip(rng.integers(0, 20, n), y)]
    free = [float(v) if i % 7 else None for i, v in enumerate(rng.normal(size=n))]
    y[5] = None
    rows = list(zip(near, tied, free, [1.0] * n, y)) + [(0.5, 1.0, 1.0, 1.0, 9)]
    df = spark.createDataFrame(rows, "near double, tied double, free double, same double, y int")
    got = {r.feature: r.score for r in nearest_mutual_information(df, ["near", "tied", "free", "same"], "y").collect()}
    for i, c in enumerate(("near", "tied", "free", "same")):
        assert abs(got[c] - plain([r[i] for r in rows], [r[4] for r in rows])) < 1e-9, c
    assert got["near"] > 0.3 > got["free"] and got["same"] == 0.0
    assert nearest_mutual_information(df.where("false"), ["near"], "y").collect() == []


def test_digamma(spark):
    values = spark.range(1, 200).select("id", digamma(F.col("id")).alias("d")).collect()
    assert max(abs(r.d - plain_digamma(r.id)) for r in values) < 1e-9
