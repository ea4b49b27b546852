"""The perceptron's gradients, its optimiser, and its fit against Spark's own."""

import numpy as np
import pytest

from aerogrid.operators import models, perceptron

LAYERS = [3, 5, 4, 2]


def rows(n):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, 3))
    return x, (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=n) > 0).astype(int)


def test_gradient_is_that_of_the_loss():
    x, y = rows(50)
    size = sum((a + 1) * b for a, b in zip(LAYERS, LAYERS[1:]))
    w = np.random.default_rng(1).normal(size=size)
    gradient = np.zeros(size)
    loss = perceptron.add_gradient(x, y, w, LAYERS, gradient)
    assert loss > 0
    for i in range(size):
        moved = [w + d * np.eye(size)[i] for d in (1e-6, -1e-6)]
        a, b = (perceptron.add_gradient(x, y, m, LAYERS, np.zeros(size)) for m in moved)
        assert (a - b) / 2e-6 == pytest.approx(gradient[i], abs=1e-4)


def test_optimiser_finds_the_least_and_stops():
    asked = []

    def valley(p):
        asked.append(p)
        a, b = p
        return (1 - a) ** 2 + 100 * (b - a * a) ** 2, np.array([-2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)])

    assert perceptron.minimise(valley, np.array([-1.2, 1.0]), 500, 1e-12) == pytest.approx([1, 1], abs=1e-4)
    assert len(asked) < 200
    assert (perceptron.minimise(lambda p: (np.nan, p * np.nan), np.ones(2), 500, 1e-6) == 1).all()


def test_many_rows_are_fitted_as_spark_does(spark, monkeypatch):
    x, y = rows(2560)  # whole blocks of 128: to Spark all blocks count alike, to these passes all rows
    table = spark.createDataFrame([(*map(float, v), int(t)) for v, t in zip(x, y)], "x0 double, x1 double, x2 double, y int").coalesce(1).cache()
    fit = lambda n: models.fit(table, "neural_network", ["x0", "x1", "x2"], "y", hidden=[6, 4], maxIter=n)
    for n, far in ((12, 1e-6), (150, 0.05)):  # rounding differs, and grows with the steps
        own, made = [], perceptron.minimise
        with monkeypatch.context() as m:
            m.setattr(perceptron, "MANY_ROWS", 100)
            m.setattr(perceptron, "minimise", lambda *a: own.append(made(*a)) or own[-1])
            ours = fit(n)
        assert len(own) == 1 and (ours.stages[-1].weights.toArray() == own[0]).all()
        theirs = fit(n)
        a, b = (np.array([r["score"] for r in models.score(m, table).collect()]) for m in (ours, theirs))
        assert np.abs(a - b).mean() < far
        assert ours.stages[-1].getMaxIter() == n
    assert models.evaluate(models.score(ours, table), "y").first()["auc"] > 0.9
