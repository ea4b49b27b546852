"""Evaluation of binary and multi-class predictions as aggregations; no predictions come to the driver."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerogrid.functions.num import ratio
from aerogrid.operators.ordering import running_totals


def confusion(df: DataFrame, y: str = "y", yhat: str = "yhat", by: Sequence[str] = (), normalise: bool = False) -> DataFrame:
    """Counts per true and predicted class; optionally the share within the true class."""
    cells = df.groupBy(*by, y, yhat).agg(F.count(F.lit(1)).alias("n"))
    if not normalise:
        return cells
    return cells.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by, y)))


def confusion_wide(df: DataFrame, classes: Sequence, y: str = "y", yhat: str = "yhat", by: Sequence[str] = ()) -> DataFrame:
    """Confusion matrix with one column per predicted class."""
    return confusion(df, y, yhat, by).groupBy(*by, y).pivot(yhat, list(classes)).agg(F.sum("n")).fillna(0)


def _f1(p: Column, r: Column) -> Column:
    return ratio(2.0 * p * r, p + r)


def binary_metrics(df: DataFrame, y: str = "y", yhat: str = "yhat", by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall and F1 of the positive class; zero where undefined."""
    a, p = F.col(y), F.col(yhat)
    cells = df.groupBy(*by).agg(
        F.count_if((a == 1) & (p == 1)).alias("tp"),
        F.count_if((a == 0) & (p == 1)).alias("fp"),
        F.count_if((a == 1) & (p == 0)).alias("fn"),
        F.count_if((a == 0) & (p == 0)).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return cells.select(
        *by,
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        _f1(precision, recall).alias("f1"),
    )


def class_report(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Precision, recall, F1 and support per class."""
    sides = F.array(
        F.struct(F.col(y).alias("cls"), F.lit(1).alias("truth"), F.lit(0).alias("guess"), (F.col(y) == F.col(yhat)).cast("int").alias("hit")),
        F.struct(F.col(yhat).alias("cls"), F.lit(0).alias("truth"), F.lit(1).alias("guess"), F.lit(0).alias("hit")),
    )
    cells = (
        confusion(df, y, yhat)
        .select("n", F.explode(sides).alias("_e"))
        .groupBy(F.col("_e.cls").alias("class"))
        .agg(
            F.sum(F.col("n") * F.col("_e.hit")).alias("hits"),
            F.sum(F.col("n") * F.col("_e.truth")).alias("support"),
            F.sum(F.col("n") * F.col("_e.guess")).alias("guessed"),
        )
    )
    precision, recall = ratio(F.col("hits"), F.col("guessed")), ratio(F.col("hits"), F.col("support"))
    return cells.select(
        "class", precision.alias("precision"), recall.alias("recall"), _f1(precision, recall).alias("f1"), "support"
    )


def weighted_metrics(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Per-class metrics averaged by support, with the accuracy."""
    report = class_report(df, y, yhat)
    mean = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    # with support as weight the mean recall is the accuracy
    return report.agg(
        mean("recall").alias("accuracy"),
        mean("precision").alias("precision"),
        mean("recall").alias("recall"),
        mean("f1").alias("f1"),
    )


def negative_class_rates(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Recall and precision of class 0, under their proper names."""
    a, p = F.col(y), F.col(yhat)
    return df.agg(
        ratio(F.count_if((a == 0) & (p == 0)), F.count_if(a == 0)).alias("class0_recall"),
        ratio(F.count_if((a == 0) & (p == 0)), F.count_if(p == 0)).alias("class0_precision"),
    )


def curve_counts(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """True and false positives at every distinct score, counted from the highest score down."""
    marked = df.select(*by, score, F.col(y).cast("long").alias("tp"), (1 - F.col(y)).cast("long").alias("fp"))
    return running_totals(marked, by, score, ["tp", "fp"], descending=True)


def roc_points(df: DataFrame, y: str = "y", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    cum = curve_counts(df, y, score, by)
    return cum.select(
        *by,
        F.col(score).alias("threshold"),
        ratio(F.col("fp_cum"), F.col("fp_total")).alias("fpr"),
        ratio(F.col("tp_cum"), F.col("tp_total")).alias("tpr"),
    )


def roc_auc(df: DataFrame, y: str = "y", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve; tied scores count half (null if a class is absent)."""
    cum = curve_counts(df, y, score, by)
    area = F.col("fp") * (F.col("tp_cum") + F.col("tp_cum") - F.col("tp")) / 2.0
    total = F.max("tp_total").cast("double") * F.max("fp_total")
    return cum.groupBy(*by).agg(F.try_divide(F.sum(area), total).alias("auc"))


def pr_points(df: DataFrame, y: str = "y", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    cum = curve_counts(df, y, score, by)
    return cum.select(
        *by,
        F.col(score).alias("threshold"),
        ratio(F.col("tp_cum"), F.col("tp_cum") + F.col("fp_cum")).alias("precision"),
        ratio(F.col("tp_cum"), F.col("tp_total")).alias("recall"),
    )


def threshold_table(
    df: DataFrame,
    y: str = "y",
    score: str = "score",
    by: Sequence[str] = (),
    thresholds: Sequence[float] = tuple(i / 20 for i in range(2, 18)),
    strict: bool = False,
) -> DataFrame:
    """Precision, recall and F1 at every threshold, from one pass of conditional counts."""
    s, pos = F.col(score), F.col(y) == 1
    aggs = [F.count_if(pos).alias("_p")]
    for i, t in enumerate(thresholds):
        hit = s > F.lit(float(t)) if strict else s >= F.lit(float(t))
        aggs += [F.count_if(hit & pos).alias(f"_tp{i}"), F.count_if(hit & ~pos).alias(f"_fp{i}")]
    row = df.groupBy(*by).agg(*aggs)
    entries = [
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_tp{i}").alias("tp"), F.col(f"_fp{i}").alias("fp"))
        for i, t in enumerate(thresholds)
    ]
    long = row.select(*by, "_p", F.explode(F.array(*entries)).alias("_e")).select(*by, "_p", "_e.*")
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("_p"))
    return long.select(
        *by,
        "threshold",
        precision.alias("precision"),
        recall.alias("recall"),
        _f1(precision, recall).alias("f1"),
    )


def best_threshold(df: DataFrame, y: str = "y", score: str = "score", by: Sequence[str] = (), **kw) -> DataFrame:
    """Threshold of the highest F1; the lowest one on a tie, 0.5 if every F1 is zero."""
    table = threshold_table(df, y, score, by, **kw)
    top = F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.col("threshold")))
    return (
        table.groupBy(*by)
        .agg(top.alias("b"))
        .select(*by, F.when(F.col("b.f1") > 0, F.col("b.threshold")).otherwise(0.5).alias("threshold"), F.col("b.f1").alias("f1"))
    )


def soft_vote(scores: Sequence[Column], weights: Sequence[float]) -> Column:
    """Weighted mean of model probabilities."""
    total = reduce(lambda a, b: a + b, [s * F.lit(float(w)) for s, w in zip(scores, weights)])
    return total / F.lit(float(sum(weights)))


def hard_vote(votes: Sequence[Column], weights: Sequence[float]) -> Column:
    """1 where the weighted votes exceed half of the weights."""
    total = reduce(lambda a, b: a + b, [v * F.lit(float(w)) for v, w in zip(votes, weights)])
    return (total > F.lit(sum(weights) / 2.0)).cast("int")


def model_accuracy(df: DataFrame, y: str, predictions: dict[str, Column]) -> DataFrame:
    """Accuracy of each base model and of the ensemble, one row each."""
    entries = [F.struct(F.lit(n).alias("model"), (F.col(y) == p).cast("double").alias("hit")) for n, p in predictions.items()]
    long = df.select(F.explode(F.array(*entries)).alias("_e"))
    return long.groupBy(F.col("_e.model").alias("model")).agg(F.avg("_e.hit").alias("accuracy"))


def confidence_summary(df: DataFrame, confidence: Column, correct: Column | None = None) -> DataFrame:
    """Mean confidence and the shares above 0.9 and below 0.6, optionally by correctness."""
    by = [] if correct is None else [correct.alias("correct")]
    c = confidence
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(c).alias("mean_confidence"),
        F.avg((c > 0.9).cast("double")).alias("high_share"),
        F.avg((c < 0.6).cast("double")).alias("low_share"),
    )
