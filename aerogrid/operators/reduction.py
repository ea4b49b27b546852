"""Dimensionality reduction and projections.

Fits reduce the table to matrices of columns x columns by aggregation; applying one is a projection
made of column expressions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerogrid.session import settle


def linear(columns: Sequence[str], weights: Sequence[float], offsets: Sequence[float] | None = None) -> Column:
    """Weighted sum of columns, each less its offset."""
    out = F.lit(0.0)
    for i, (c, w) in enumerate(zip(columns, weights)):
        x = F.col(c) - F.lit(float(offsets[i])) if offsets is not None else F.col(c)
        out = out + x * F.lit(float(w))
    return out


def _means(df: DataFrame, columns: Sequence[str]) -> list[float]:
    row = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return [float(row[c] or 0.0) for c in columns]


def fit_pca(df: DataFrame, columns: Sequence[str], variance: float = 0.95) -> dict:
    """Components that keep a share of the variance; the largest weight of each is positive."""
    means = _means(df, columns)
    assembled = VectorAssembler(inputCols=list(columns), outputCol="_x", handleInvalid="skip").transform(
        df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    )
    model = PCA(k=len(columns), inputCol="_x", outputCol="_y").fit(assembled)
    explained = model.explainedVariance.toArray()
    k = int(np.searchsorted(np.cumsum(explained), variance - 1e-12) + 1)
    parts = model.pc.toArray()[:, : min(k, len(columns))]
    signs = np.sign(parts[np.argmax(np.abs(parts), axis=0), range(parts.shape[1])])
    return {
        "columns": list(columns),
        "means": means,
        "components": (parts * signs).T.tolist(),
        "explained": explained.tolist(),
    }


def project(df: DataFrame, state: dict, prefix: str = "pc") -> DataFrame:
    """Replace the fitted columns by their components."""
    cols = state["columns"]
    made = [
        linear(cols, w, state.get("means")).alias(f"{prefix}_{i}") for i, w in enumerate(state["components"])
    ]
    return df.select(*[c for c in df.columns if c not in cols], *made)


def reconstruction_error(df: DataFrame, state: dict, out: str = "error") -> DataFrame:
    """Mean squared error of rebuilding a row from its components."""
    cols, means = state["columns"], state["means"]
    parts = np.array(state["components"])
    residual = np.eye(len(cols)) - parts.T @ parts  # row minus its projection, in one matrix
    errors = [F.pow(linear(cols, residual[i], means), F.lit(2.0)) for i in range(len(cols))]
    total = errors[0]
    for e in errors[1:]:
        total = total + e
    return df.withColumn(out, total / F.lit(float(len(cols))))


def gram_matrix(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    index = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(*[F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"_{i}_{j}") for i, j in index]).first()
    gram = np.zeros((len(columns), len(columns)))
    for i, j in index:
        gram[i, j] = gram[j, i] = row[f"_{i}_{j}"] or 0.0
    return gram


def fit_svd(df: DataFrame, columns: Sequence[str], k: int = 50) -> dict:
    """Leading right singular vectors (the columns are not centred), from the Gram matrix."""
    values, vectors = np.linalg.eigh(gram_matrix(df, columns))
    order = np.argsort(values)[::-1][: min(k, len(columns))]
    parts = vectors[:, order]
    signs = np.sign(parts[np.argmax(np.abs(parts), axis=0), range(parts.shape[1])])
    return {
        "columns": list(columns),
        "components": (parts * signs).T.tolist(),
        "singular_values": np.sqrt(np.maximum(values[order], 0.0)).tolist(),
    }


def _row_weights(x: np.ndarray, h: np.ndarray, steps: int) -> np.ndarray:
    """Non-negative row weights w with x ~ w h, by multiplicative steps."""
    w = np.full((x.shape[0], h.shape[0]), 1.0 / h.shape[0])
    gram = h @ h.T
    for _ in range(steps):
        w *= (x @ h.T) / (w @ gram + 1e-12)
    return w


def fit_nmf(df: DataFrame, columns: Sequence[str], k: int = 30, iterations: int = 10, steps: int = 20) -> dict:
    """Non-negative factorisation x ~ w h.

    Each iteration is one pass: rows solve their own weights, partitions send back only the k x k and
    k x columns sums, and the small factor is updated from them.
    """
    columns = list(columns)
    k = min(k, len(columns))
    start = np.random.default_rng(42)
    tops = df.agg(*[F.max(c).alias(c) for c in columns]).first()
    scale = np.array([float(tops[c] or 1.0) or 1.0 for c in columns])
    h = start.uniform(0.1, 1.0, (k, len(columns)))
    numbers = settle(df.select(*[F.col(c).cast("double").alias(c) for c in columns]))
    width = k * len(columns) + k * k

    for _ in range(iterations):

        def partial(batches, h=h):
            total = np.zeros(width)
            for pdf in batches:
                x = pdf.to_numpy() / scale
                w = _row_weights(x, h, steps)
                total += np.concatenate([(w.T @ x).ravel(), (w.T @ w).ravel()])
            yield pd.DataFrame({"cell": np.arange(width), "value": total})

        cells = numbers.mapInPandas(partial, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("v"))
        sums = np.zeros(width)
        for row in cells.collect():  # k * (k + columns) numbers
            sums[row["cell"]] = row["v"]
        wx, ww = sums[: k * len(columns)].reshape(k, -1), sums[k * len(columns) :].reshape(k, k)
        h = h * wx / (ww @ h + 1e-12)
    return {"columns": columns, "scale": scale.tolist(), "factor": h.tolist(), "steps": steps}


def apply_nmf(df: DataFrame, state: dict, prefix: str = "nmf") -> DataFrame:
    """Row weights of a fitted factorisation, in Arrow batches."""
    cols, h, scale = state["columns"], np.array(state["factor"]), np.array(state["scale"])
    steps = state["steps"]

    @F.pandas_udf("array<double>")
    def weights(*series: pd.Series) -> pd.Series:
        x = np.column_stack([s.to_numpy(dtype=float) for s in series]) / scale
        return pd.Series(list(_row_weights(x, h, steps)))

    made = df.withColumn("_w", weights(*[F.col(c).cast("double") for c in cols]))
    return made.select(*df.columns, *[F.col("_w")[i].alias(f"{prefix}_{i}") for i in range(len(h))])


def random_matrix(columns: int, n: int = 10, method: str = "random_projection", seed: int = 42) -> tuple[np.ndarray, np.ndarray | None]:
    """Weights of `n` synthetic features, and their shifts for the RBF kernel."""
    rng = np.random.default_rng(seed)
    if method == "random_projection":
        return rng.normal(0.0, 1.0 / math.sqrt(n), (n, columns)), None
    if method == "rbf":
        return rng.normal(0.0, math.sqrt(2.0), (n, columns)), rng.uniform(0.0, 2.0 * math.pi, n)
    raise ValueError(f"unknown method {method}")


def random_features(
    df: DataFrame, columns: Sequence[str], n: int = 10, method: str = "random_projection", seed: int = 42
) -> DataFrame:
    """Synthetic features: Gaussian random projections, or random Fourier features of an RBF kernel."""
    matrix, shifts = random_matrix(len(columns), n, method, seed)
    sums = [linear(columns, w) for w in matrix]
    if shifts is not None:
        sums = [F.cos(x + F.lit(float(b))) * F.lit(math.sqrt(2.0 / n)) for x, b in zip(sums, shifts)]
    return df.select("*", *[x.alias(f"synthetic_{i}") for i, x in enumerate(sums)])
