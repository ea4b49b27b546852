"""The multilayer perceptron of Spark ML for many rows: the same model, loss and optimiser, with passes over matrices.

Spark's own fit takes its gradients in the JVM, of blocks of 128 rows, which all count alike.  Here each task takes them of matrices of
`CHUNK` rows and adds them up, and the driver adds up one gradient per task and makes the step of limited-memory BFGS with
Spark's line search, history and tests of convergence.  Model, starting weights and storage are Spark's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MANY_ROWS = 100_000  # fewer are fitted by Spark, whose passes start sooner
CHUNK = 512  # rows whose layers stay in a core's cache
BLOCK = 8192  # rows of a stored block
HISTORY = 10  # steps that the optimiser remembers
FLAT = 20  # values of the loss that must be alike at the end

Loss = Callable[[np.ndarray], tuple[float, np.ndarray]]


def layered(weights: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(matrix from inputs to outputs, bias) of each layer, as views of Spark's order of weights."""
    out, at = [], 0
    for n_in, n_out in zip(layers, layers[1:], strict=False):
        out.append((weights[at : at + n_in * n_out].reshape(n_in, n_out), weights[at + n_in * n_out : at + n_in * n_out + n_out]))
        at += n_in * n_out + n_out
    return out


def add_gradient(x: np.ndarray, y: np.ndarray, weights: np.ndarray, layers: list[int], into: np.ndarray) -> float:
    """The sum of the rows' cross entropies; the sum of their gradients is added to `into`."""
    steps, grads = layered(weights, layers), layered(into, layers)
    values = [x]
    for matrix, bias in steps:
        z = values[-1] @ matrix
        z += bias
        if len(values) < len(steps):  # the logistic function; an infinite power gives 0
            np.negative(z, out=z)
            np.exp(z, out=z)
            z += 1.0
            np.reciprocal(z, out=z)
        values.append(z)
    z, rows = values[-1], np.arange(len(x))
    z -= z.max(axis=1, keepdims=True)
    own = z[rows, y]
    delta = np.exp(z)
    total = delta.sum(axis=1, keepdims=True)
    delta /= total
    delta[rows, y] -= 1.0
    for i in range(len(steps) - 1, -1, -1):
        into_matrix, into_bias = grads[i]
        into_matrix += values[i].T @ delta
        into_bias += delta.sum(axis=0)
        if i:
            a = values[i]
            delta = delta @ steps[i][0].T
            delta *= a
            delta *= np.subtract(1.0, a, out=a)
    return float(np.log(total).sum() - own.sum())


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of features and labels."""
    for batch in batches:
        for at in range(0, len(batch), BLOCK):
            part = batch.slice(at, BLOCK)
            x, y = part["x"].flatten().to_numpy(zero_copy_only=False), part["y"].to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (x.astype(np.float64), y.astype(np.int64))], ["x", "y"])


def _passed(weights: np.ndarray, layers: list[int]):
    """Loss, gradient and rows of a task's blocks."""

    def run(blocks: Iterator[tuple[bytes, bytes]]) -> Iterator[tuple[float, bytes, int]]:
        loss, gradient, n = 0.0, np.zeros(len(weights)), 0
        with np.errstate(all="ignore"):
            for xs, ys in blocks:
                y = np.frombuffer(ys, np.int64)
                x = np.frombuffer(xs, np.float64).reshape(len(y), layers[0])
                for at in range(0, len(y), CHUNK):
                    loss += add_gradient(x[at : at + CHUNK], y[at : at + CHUNK], weights, layers, gradient)
                n += len(y)
        yield loss, gradient.tobytes(), n

    return run


class Perceptron(MultilayerPerceptronClassifier):
    """Spark's classifier, but tables of over `MANY_ROWS` rows are fitted by the passes of this module."""

    def _fit(self, dataset: DataFrame) -> MultilayerPerceptronClassificationModel:
        if self.getSolver() != "l-bfgs" or dataset.count() <= MANY_ROWS:
            return super()._fit(dataset)
        layers = self.getLayers()
        start = self._without_steps(self.copy(), dataset).weights.toArray()  # one pass, which also tells wrong labels
        cores = dataset.sparkSession.sparkContext.defaultParallelism
        rows = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"))
        blocks = rows.mapInArrow(_packed, "x binary, y binary").repartition(cores).rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)

        def loss(weights: np.ndarray) -> tuple[float, np.ndarray]:
            found = blocks.mapPartitions(_passed(weights, layers)).collect()  # one gradient per core, in order
            n = sum(k for _, _, k in found)
            return sum(v for v, _, _ in found) / n, sum(np.frombuffer(g) for _, g, _ in found) / n

        try:
            weights = minimise(loss, start, self.getMaxIter(), self.getTol())
        finally:
            blocks.unpersist()
        one = dataset.sparkSession.createDataFrame([(Vectors.dense([0.0] * layers[0]), 0.0)], [self.getFeaturesCol(), self.getLabelCol()])
        model = self._without_steps(self.copy({self.initialWeights: Vectors.dense(weights)}), one)
        model.clear(model.initialWeights)
        return model._set(maxIter=self.getMaxIter())

    @staticmethod
    def _without_steps(estimator: Perceptron, dataset: DataFrame) -> MultilayerPerceptronClassificationModel:
        """Spark's model with the starting weights."""
        return MultilayerPerceptronClassifier._fit(estimator._set(maxIter=0), dataset)


# ---------------------------------------------------------------- the optimiser


class _Failed(Exception):
    """A step that cannot be made."""


def _direction(steps: list[np.ndarray], changes: list[np.ndarray], gradient: np.ndarray) -> np.ndarray:
    """Downhill by the remembered steps and changes of the gradient, newest last."""
    if not steps:
        return -gradient
    out, shares = gradient.copy(), []
    for s, c in zip(reversed(steps), reversed(changes), strict=True):
        shares.append((s @ out) / (s @ c))
        out -= shares[-1] * c
    scale = (steps[-1] @ changes[-1]) / (changes[-1] @ changes[-1])
    if not scale >= 0:
        raise _Failed("the remembered steps lead uphill")
    out *= scale
    for s, c, share in zip(steps, changes, reversed(shares), strict=True):
        out += s * (share - (c @ out) / (s @ c))
    return -out


def _between(left: tuple, right: tuple) -> float:
    """Where the cubic through two (place, value, slope) is least, not too near to either."""
    (a, fa, da), (b, fb, db) = left, right
    d1 = da + db - 3 * (fa - fb) / (a - b)
    d2 = np.sqrt(d1 * d1 - da * db)
    t = b - (b - a) * (db + d2 - d1) / (db - da + 2 * d2)
    return min(max(t, a + 0.1 * (b - a)), a + 0.9 * (b - a)) if t == t else t


def _step_size(phi: Callable[[float], tuple], first: tuple, t: float) -> float:
    """A step that meets the strong Wolfe conditions; `phi` gives (place, value, slope)."""
    _, value, slope = low = first
    if slope > 0:
        raise _Failed("uphill")
    low_enough = lambda c: c[1] <= value + 1e-4 * c[0] * slope
    flat_enough = lambda c: abs(c[2]) <= 0.9 * abs(slope)

    def zoom(low: tuple, high: tuple) -> float:
        for _ in range(10):
            c = phi(_between(*sorted((low, high), key=lambda b: b[0])))
            if not low_enough(c) or c[1] >= low[1]:
                high = c
                continue
            if flat_enough(c):
                return c[0]
            if c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        raise _Failed("no step found between two")

    for i in range(10):
        c = phi(t)
        if not np.isfinite(c[1]):
            t /= 2.0
            continue
        if not low_enough(c) or (c[1] >= low[1] and i):
            return zoom(low, c)
        if flat_enough(c):
            return c[0]
        if c[2] >= 0:
            return zoom(c, low)
        low, t = c, t * 1.5
    raise _Failed("no step found")


def minimise(loss: Loss, x: np.ndarray, most: int, tolerance: float) -> np.ndarray:
    """Limited-memory BFGS as Spark runs it: `most` steps, or fewer if the loss or its gradient no longer changes, or no step is found twice."""
    last: tuple[np.ndarray, tuple[float, np.ndarray]] | None = None

    def at(place: np.ndarray) -> tuple[float, np.ndarray]:
        nonlocal last
        if last is None or not np.array_equal(last[0], place):
            last = place, loss(place)
        return last[1]

    value, gradient = at(x)
    beginning, recent = abs(value), [np.inf]
    steps: list[np.ndarray] = []
    changes: list[np.ndarray] = []
    done, failed = 0, False
    while done < most:
        if len(recent) >= 2 and abs(value - max(recent)) <= tolerance * beginning:
            break
        if np.linalg.norm(gradient) <= max(tolerance * abs(value), 1e-8):
            break
        try:
            with np.errstate(all="ignore"):
                way = _direction(steps, changes, gradient)

                def phi(t: float, x=x, way=way) -> tuple[float, float, float]:
                    v, g = at(x + way * t)
                    return t, v, float(g @ way)

                size = _step_size(phi, (0.0, value, float(gradient @ way)), 1.0 if done else 1.0 / np.linalg.norm(way))
                if size * np.linalg.norm(gradient) < 1e-10:
                    raise _Failed("no way to go")
                there = x + way * size
                new_value, new_gradient = at(there)
        except _Failed:
            if failed:
                break
            failed, steps, changes = True, [], []
            continue
        steps, changes = [*steps, there - x][-HISTORY:], [*changes, new_gradient - gradient][-HISTORY:]
        x, value, gradient = there, new_value, new_gradient
        recent, done, failed = [*recent, value][-FLAT:], done + 1, False
    return x
