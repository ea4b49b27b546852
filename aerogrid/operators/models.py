"""Classifiers on Spark ML: fitting, scoring, cross-validation, stacking, packaging, importances."""

from __future__ import annotations

import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerogrid.operators import metrics
from aerogrid.operators.balance import stratified_folds
from aerogrid.operators.forest import Forest
from aerogrid.operators.perceptron import Perceptron
from aerogrid.session import checkpoint_dir, part_sizes, settle, uneven

# Settings of the four classifiers of the balanced flow.
SETTINGS = {
    "random_forest": {"numTrees": 300, "maxDepth": 20, "minInstancesPerNode": 2, "minInstancesSplit": 5},  # sqrt of the features a node
    "gradient_boosting": {"maxIter": 200, "stepSize": 0.1, "maxDepth": 5, "subsamplingRate": 0.8},
    "logistic_regression": {"maxIter": 1000},  # the penalty is that of C = 1, see fit()
    "neural_network": {"hidden": [100, 50], "maxIter": 500},
}


def classifier(kind: str, columns: Sequence[str], label: str, weight: str | None = None, seed: int = 42, **overrides):
    """An unfitted classifier with the default settings unless overridden; all but the forest read `features`."""
    kw = {**SETTINGS[kind], **overrides}
    if kind == "random_forest":
        return Forest(columns=list(columns), labelCol=label, weightCol=weight or "", seed=seed, **kw)
    common = {"featuresCol": "features", "labelCol": label}
    if kind == "neural_network":
        return Perceptron(layers=[len(columns), *kw.pop("hidden"), 2], seed=seed, **common, **kw)
    if weight:
        common["weightCol"] = weight
    if kind == "gradient_boosting":
        return GBTClassifier(seed=seed, **common, **kw)
    return LogisticRegression(**common, **kw)


def pipeline(kind: str, columns: Sequence[str], label: str, weight: str | None = None, seed: int = 42, **kw) -> Pipeline:
    """Assemble, scale, classify; trees need no scale."""
    if kind == "random_forest":
        return Pipeline(stages=[classifier(kind, columns, label, weight, seed, **kw)])
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(columns), outputCol="_raw", handleInvalid="keep"),
            StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True),
            classifier(kind, columns, label, weight, seed, **kw),
        ]
    )


SPREAD_ROWS = 100_000  # fewer are not worth a shuffle


def _spread(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns' rows dealt evenly over the cores, if some partition holds over twice its share."""
    n, rows = df.sparkSession.sparkContext.defaultParallelism, df.select(*columns)
    sizes = part_sizes(rows)
    if sum(sizes) < SPREAD_ROWS or not uneven(sizes, n):
        return df
    return settle(rows.repartition(n))


def fit(df: DataFrame, kind: str, columns: Sequence[str], label: str, weight: str | None = None, **kw) -> PipelineModel:
    checkpoint_dir(df.sparkSession)  # boosting cuts its lineage there
    if kind == "logistic_regression" and "regParam" not in kw:
        kw["regParam"] = 1.0 / max(1, df.count())  # the loss here is a mean, not a sum
    if kind in ("neural_network", "gradient_boosting"):  # they pass over the rows hundreds of times
        df = _spread(df, [*columns, label, *([weight] if weight else [])])
    return pipeline(kind, columns, label, weight, **kw).fit(df)


def score(model: PipelineModel, df: DataFrame, out: str = "score") -> DataFrame:
    """Add the probability of the positive class; the scan only reads what the model needs."""
    scored = model.transform(df)
    return scored.select(*df.columns, vector_to_array("probability")[1].alias(out))


def importances(model: PipelineModel, columns: Sequence[str], spark: SparkSession) -> DataFrame:
    """Feature importances (absolute coefficients for the linear model), largest first."""
    last = model.stages[-1]
    values = last.featureImportances if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    rows = [(c, float(v)) for c, v in zip(columns, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def evaluate(scored: DataFrame, label: str, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1 and AUC of scored rows."""
    hard = scored.withColumn("_yhat", (F.col("score") >= threshold).cast("int"))
    rates = metrics.binary_metrics(hard, label, "_yhat", by)
    area = metrics.roc_auc(scored, label, "score", by)
    return rates.join(area, list(by)) if by else rates.join(F.broadcast(area), F.lit(True))  # one row each


# ---------------------------------------------------------------- validation and tuning


def out_of_fold(
    df: DataFrame, kind: str, columns: Sequence[str], label: str, keys: Sequence[str], k: int = 5, **kw
) -> DataFrame:
    """Every row scored by the model that did not see its fold; the folds are fitted at the same time.

    A table that has its folds already, in `fold`, keeps them.
    """
    folded = df if "fold" in df.columns else settle(stratified_folds(df, label, keys, k))

    def one(i: int) -> DataFrame:
        model = fit(folded.where(F.col("fold") != i), kind, columns, label, **kw)
        return score(model, folded.where(F.col("fold") == i))

    with ThreadPoolExecutor(min(k, 4)) as pool:
        parts = list(pool.map(one, range(k)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def cross_validate(df: DataFrame, kind: str, columns: Sequence[str], label: str, keys: Sequence[str], k: int = 5, **kw):
    """Metrics of every fold; the rows are scored once for all of them."""
    scored = out_of_fold(df, kind, columns, label, keys, k, **kw).select(label, "fold", "score")
    return evaluate(settle(scored), label, by=["fold"])


def train_many(df: DataFrame, test: DataFrame, runs: dict[str, dict], columns: Sequence[str], label: str) -> DataFrame:
    """Fit several models over the same rows from a small thread pool; one result row per model."""
    spark = df.sparkSession

    def one(item):
        name, kw = item
        began = time.monotonic()
        try:
            model = fit(df, columns=columns, label=label, **kw)
            row = evaluate(score(model, test), label).first()
            return (name, *[float(v) if v is not None else None for v in row], time.monotonic() - began, None)
        except Exception as e:  # a failed run is a result too
            return (name, None, None, None, None, None, time.monotonic() - began, str(e))

    with ThreadPoolExecutor(min(len(runs), 4)) as pool:
        rows = list(pool.map(one, runs.items()))
    return spark.createDataFrame(
        rows,
        "model string, accuracy double, precision double, recall double, f1 double, auc double, time_s double, error string",
    )


def grid_search(
    df: DataFrame, kind: str, columns: Sequence[str], label: str, keys: Sequence[str], space: dict[str, Sequence], k: int = 3,
    draws: int | None = None, **kw,
) -> DataFrame:
    """Cross-validated mean, deviation and rank of every combination, or of `draws` of them by hash."""
    spark = df.sparkSession
    flow = pipeline(kind, columns, label, **kw)
    last = flow.getStages()[-1]
    if kind == "random_forest":
        flow = last  # alone, it fits all combinations of a fold over the same ranges
    grid = ParamGridBuilder()
    for name, values in space.items():
        grid = grid.addGrid(last.getParam(name), list(values))
    maps = grid.build()
    if draws is not None:
        listed = spark.createDataFrame([(i,) for i in range(len(maps))], "trial_id long")
        from aerogrid.operators.results import sample_trials

        picked = {r["trial_id"] for r in sample_trials(listed, "trial_id", draws).collect()}
        maps = [m for i, m in enumerate(maps) if i in picked]
    folded = settle(stratified_folds(df, label, keys, k))
    search = CrossValidator(
        estimator=flow,
        estimatorParamMaps=maps,
        evaluator=BinaryClassificationEvaluator(labelCol=label),
        numFolds=k,
        foldCol="fold",
        parallelism=4,
    ).fit(folded)
    rows = [
        (i, {p.name: str(v) for p, v in m.items()}, float(a), float(s))
        for i, (m, a, s) in enumerate(zip(maps, search.avgMetrics, search.stdMetrics))
    ]
    table = spark.createDataFrame(rows, "trial_id long, params map<string,string>, mean_auc double, std_auc double")
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("mean_auc"))  # one row per trial
    return table.withColumn("rank", F.rank().over(w))


# ---------------------------------------------------------------- ensembles


def stack(
    df: DataFrame, base: dict[str, dict], columns: Sequence[str], label: str, keys: Sequence[str], k: int = 5, meta="logistic_regression",
    **meta_kw,
) -> DataFrame:
    """Out-of-fold scores of the base models feed a meta-learner; returns its scores for every row.

    The base scores come from models that did not see the row, so the meta-learner does not learn their
    training error.
    """
    folded = settle(stratified_folds(df, label, keys, k))
    joined = None
    for name, kw in base.items():
        part = out_of_fold(folded, columns=columns, label=label, keys=keys, k=k, **kw)
        part = part.select(*keys, label, F.col("score").alias(name))
        joined = part if joined is None else joined.join(part.drop(label), list(keys))
    joined = settle(joined)
    model = fit(joined, meta, list(base), label, **meta_kw)
    return score(model, joined)


# ---------------------------------------------------------------- packages


def save_package(model: PipelineModel, path: str, columns: Sequence[str], threshold: float, spark: SparkSession) -> None:
    """Model with its scaler, and a sidecar with the column list and the threshold."""
    model.write().overwrite().save(f"{path}/model")
    side = spark.createDataFrame([(list(columns), float(threshold))], "columns array<string>, threshold double")
    side.write.mode("overwrite").json(f"{path}/package")


def load_package(path: str, spark: SparkSession) -> tuple[PipelineModel, list[str], float]:
    side = spark.read.schema("columns array<string>, threshold double").json(f"{path}/package").first()
    return PipelineModel.load(f"{path}/model"), list(side["columns"]), float(side["threshold"])


def score_package(df: DataFrame, path: str) -> DataFrame:
    """Batch scoring with a stored model and its threshold."""
    model, _, threshold = load_package(path, df.sparkSession)
    return score(model, df).withColumn("prediction", (F.col("score") >= threshold).cast("int"))


def vote_stored(df: DataFrame, results: DataFrame, weights: Sequence[float] | None = None) -> DataFrame:
    """Soft vote of the stored models whose runs succeeded; needs at least two of them."""
    paths = [r["path"] for r in results.where(F.col("error").isNull()).orderBy("path").select("path").collect()]
    if len(paths) < 2:
        raise ValueError("an ensemble needs at least two successful runs")
    out = df
    for i, path in enumerate(paths):
        model, _, _ = load_package(path, df.sparkSession)
        out = score(model, out, f"score_{i}")
    votes = [F.col(f"score_{i}") for i in range(len(paths))]
    return out.withColumn("score", metrics.soft_vote(votes, weights or [1.0] * len(paths)))


def _score_all(df: DataFrame, paths: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """A score column for each stored package, in the given order."""
    out = df
    for i, path in enumerate(paths):
        model, _, _ = load_package(path, df.sparkSession)
        out = score(model, out, f"base_{i}")
    return out, [f"base_{i}" for i in range(len(paths))]


def save_stack(df: DataFrame, packages: Sequence[str], label: str, path: str, meta: str = "logistic_regression", **meta_kw) -> None:
    """Fit a meta-learner on the scores of stored packages and store it with references to them.

    `df` must be rows that the packages were not fitted on; at least two packages are needed.
    """
    if len(packages) < 2:
        raise ValueError("a stack needs at least two stored models")
    spark = df.sparkSession
    scored, names = _score_all(df, packages)
    scored = settle(scored.select(label, *names))
    model = fit(scored, meta, names, label, **meta_kw)
    cut = metrics.best_threshold(score(model, scored).withColumnRenamed(label, "y")).first()
    save_package(model, path, names, float(cut["threshold"]) if cut else 0.5, spark)
    rows = [(i, p) for i, p in enumerate(packages)]
    spark.createDataFrame(rows, "place int, path string").write.mode("overwrite").json(f"{path}/base")


def score_stack(df: DataFrame, path: str) -> DataFrame:
    """Score with a stored stack: its packages first, then the meta-learner on their scores."""
    spark = df.sparkSession
    base = spark.read.schema("place int, path string").json(f"{path}/base").orderBy("place").collect()  # one row per model
    scored, names = _score_all(df, [r["path"] for r in base])
    return score_package(scored, path).drop(*names)


def perturbation_importance(model: PipelineModel, df: DataFrame, columns: Sequence[str], steps: int = 1) -> DataFrame:
    """Mean absolute change of the probability when one slot is zeroed.

    A slot is a feature, or with `steps` > 1 one time step of a flattened sequence (columns in step order).
    """
    width = len(columns) // steps
    slots = steps if steps > 1 else len(columns)
    span = width if steps > 1 else 1
    base = score(model, df.select(*columns), "_p0")
    spread = base.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    zeroed = [
        F.when(F.col("slot") == i // span, F.lit(0.0)).otherwise(F.col(c).cast("double")).alias(c)
        for i, c in enumerate(columns)
    ]
    moved = score(model, spread.select("slot", "_p0", *zeroed))
    return moved.groupBy("slot").agg(F.avg(F.abs(F.col("score") - F.col("_p0"))).alias("importance"))


# ---------------------------------------------------------------- feature selection by models


def elimination_path(df: DataFrame, columns: Sequence[str], label: str, kind: str, least: int, **kw) -> list[list[str]]:
    """The feature sets from all columns down to `least`: fit, drop the least important feature, repeat."""
    path = [list(columns)]
    while len(path[-1]) > least:
        model = fit(df, kind, path[-1], label, **kw)
        ranked = [r["feature"] for r in importances(model, path[-1], df.sparkSession).collect()]
        path.append([c for c in path[-1] if c != ranked[-1]])
    return path


def eliminate_features(
    df: DataFrame, columns: Sequence[str], label: str, keep: int, kind: str = "random_forest", **kw
) -> list[str]:
    """Recursive elimination down to `keep` features."""
    return elimination_path(df, columns, label, kind, keep, **kw)[-1]


def eliminate_by_validation(
    df: DataFrame, columns: Sequence[str], label: str, keys: Sequence[str], kind: str = "random_forest", k: int = 3, **kw
) -> list[str]:
    """The feature set of the elimination path with the best cross-validated AUC."""
    path = elimination_path(df, columns, label, kind, 1, **kw)
    folded = settle(stratified_folds(df, label, keys, k))
    aucs = [cross_validate(folded, kind, left, label, keys, k, **kw).agg(F.avg("auc")).first()[0] or 0.0 for left in path]
    return path[aucs.index(max(aucs))]


def lasso_features(df: DataFrame, columns: Sequence[str], label: str, strength: float = 0.001) -> list[str]:
    """Features with a non-zero coefficient in an L1 logistic regression."""
    model = fit(df, "logistic_regression", columns, label, maxIter=100, regParam=strength, elasticNetParam=1.0)
    return [c for c, v in zip(columns, model.stages[-1].coefficients.toArray()) if abs(v) > 1e-8]


def important_features(df: DataFrame, columns: Sequence[str], label: str, **kw) -> list[str]:
    """Features whose forest importance reaches the median importance."""
    rows = importances(fit(df, "random_forest", columns, label, **kw), columns, df.sparkSession).collect()
    values = sorted(r["importance"] for r in rows)
    mid = len(values) // 2
    median = values[mid] if len(values) % 2 else (values[mid - 1] + values[mid]) / 2.0
    keep = {r["feature"] for r in rows if r["importance"] >= median}
    return [c for c in columns if c in keep]


