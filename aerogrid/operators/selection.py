"""Feature scores and feature relations, each from one or two aggregations over all columns at once."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerogrid.operators.ordering import running_totals
from aerogrid.operators.prep import QuantileBins
from aerogrid.session import settle


def _explode(row: DataFrame, entries: Sequence[Column]) -> DataFrame:
    return row.select(F.explode(F.array(*entries)).alias("_e")).select("_e.*")


def mutual_information(df: DataFrame, columns: Sequence[str], target: str, bins: int = 10) -> DataFrame:
    """Plug-in mutual information (nats) between the target and each feature cut at its quantiles.

    A feature with at most `bins` distinct values keeps its values as cells.
    """
    fitted = QuantileBins(bins).fit(df, columns)
    cells = [
        F.struct(
            F.lit(c).alias("feature"),
            (fitted.bin(c).cast("string") if c in fitted.edges else (F.col(c) + F.lit(0.0)).cast("string")).alias("cell"),
        )
        for c in columns
    ]
    long = df.select(target, F.explode(F.array(*cells)).alias("_e")).where(F.col("_e.cell").isNotNull())
    counts = long.groupBy("_e.feature", "_e.cell", target).agg(F.count(F.lit(1)).alias("n"))
    by = lambda *keys: Window.partitionBy("feature", *keys)  # noqa: E731  (rows are cells now)
    n, total = F.col("n"), F.sum("n").over(by())
    nx, ny = F.sum("n").over(by("cell")), F.sum("n").over(by(target))
    terms = counts.select("feature", (n / total * F.log(n * total / (nx * ny))).alias("t"))
    return terms.groupBy("feature").agg(F.sum("t").alias("score"))


def digamma(x: Column) -> Column:
    """Digamma of whole numbers from 1 on: six steps up, then the asymptotic series."""
    z = x.cast("double") + 6.0
    series = F.log(z) - 1.0 / (2.0 * z) - 1.0 / (12.0 * z * z) + 1.0 / (120.0 * z * z * z * z) - 1.0 / (252.0 * z * z * z * z * z * z)
    return series - sum((1.0 / (x + float(j)) for j in range(6)), F.lit(0.0))


def _kth_distance(cells: DataFrame, k: int) -> DataFrame:
    """Add `r`, the distance of the k-th nearest other row of the same feature and class; rows are distinct values with their number `n`.

    Values know their places in the order of their class, so each is sent to the k places on either side: no task sorts a class.
    """
    ordered = running_totals(cells.withColumn("one", F.lit(1)), ["feature", "y"], "v", ["one", "n", "size"])
    placed = ordered.select("feature", "y", "v", "n", "size", (F.col("one_cum") - 1).alias("at"))
    sent = placed.select("feature", "y", "v", "n", "size", F.explode(F.sequence(F.lit(-k), F.lit(k))).alias("by"), "at").withColumn("at", F.col("at") + F.col("by"))
    met = sent.groupBy("feature", "y", "at").agg(F.collect_list(F.struct("v", "n")).alias("near"), F.max(F.when(F.col("by") == 0, F.struct("v", "n", "size"))).alias("own")).where("own IS NOT NULL")
    own = met.select("feature", "y", "own.*", "near").withColumn("k", F.least(F.lit(k), F.col("size") - 1))
    others = F.transform("near", lambda x: F.struct(F.abs(x["v"] - F.col("v")).alias("d"), (x["n"] - (x["v"] == F.col("v")).cast("int")).alias("w")))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0.0).alias("r"))
    step = lambda acc, x: F.when(acc["seen"] >= F.col("k"), acc).otherwise(F.struct((acc["seen"] + x["w"]).alias("seen"), x["d"].alias("r")))
    nearest = F.array_sort(F.filter(others, lambda x: x["w"] > 0))
    return own.withColumn("r", F.aggregate(nearest, start, step)["r"]).drop("near")


def nearest_mutual_information(df: DataFrame, columns: Sequence[str], target: str, k: int = 3) -> DataFrame:
    """Mutual information (nats) between a class and each feature by the k nearest rows of the same class.

    Per row: the distance of the k-th nearest row of its class, and the number of rows of any class that are nearer (equal ones, if
    that distance is 0).  Classes of a single row and missing values are left out; a negative estimate is 0.
    """
    entries = [F.struct(F.lit(c).alias("feature"), (F.col(c).cast("double") + F.lit(0.0)).alias("v")) for c in columns]
    long = df.where(F.col(target).isNotNull()).select(F.col(target).alias("y"), F.explode(F.array(*entries)).alias("e")).select("y", "e.*").where("v IS NOT NULL")
    counted = long.groupBy("feature", "y", "v").agg(F.count(F.lit(1)).alias("n"))
    classes = counted.groupBy("feature", "y").agg(F.sum("n").alias("size")).where("size > 1")  # one row per feature and class
    cells = settle(counted.join(F.broadcast(classes), ["feature", "y"]))
    placed = settle(_kth_distance(cells, k))
    bounds = placed.select("feature", F.explode(F.when(F.col("r") > 0, F.array(F.col("v") - F.col("r"), F.col("v") + F.col("r"))).otherwise(F.array("v"))).alias("v"), F.lit(0).cast("long").alias("n"))
    totals = settle(running_totals(cells.select("feature", "v", "n").unionByName(bounds), ["feature"], "v", ["n"]))
    upto = totals.select("feature", F.col("v").alias("_at"), "n", "n_cum")
    low = upto.select("feature", F.col("_at").alias("_low"), F.col("n_cum").alias("_below"))
    high = upto.select("feature", F.col("_at").alias("_high"), (F.col("n_cum") - F.col("n")).alias("_until"), F.col("n").alias("_equal"))
    asked = placed.withColumn("_low", F.col("v") - F.col("r")).withColumn("_high", F.col("v") + F.col("r"))
    inside = F.when(F.col("r") > 0, F.col("_until") - F.col("_below")).otherwise(F.col("_equal"))
    known = asked.join(low, ["feature", "_low"]).join(high, ["feature", "_high"]).withColumn("m", inside)
    mean = lambda x: F.sum(F.col("n") * digamma(x)) / F.sum("n")
    score = digamma(F.sum("n")) + mean(F.col("k")) - mean(F.col("size")) - mean(F.col("m"))
    return known.groupBy("feature").agg(F.greatest(score, F.lit(0.0)).alias("score"))


def anova_f(df: DataFrame, columns: Sequence[str], target: str, expressions: dict[str, Column] | None = None) -> DataFrame:
    """One-way F of each feature between the classes of the target."""
    exprs = expressions or {c: F.col(c) for c in columns}
    names = list(exprs)
    aggs = []
    for i, name in enumerate(names):
        x = exprs[name].cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}")]
    per_class = df.where(F.col(target).isNotNull()).groupBy(target).agg(*aggs)
    entries = [
        F.struct(
            F.lit(name).alias("feature"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("m"), F.col(f"v{i}").alias("v")
        )
        for i, name in enumerate(names)
    ]
    long = _explode(per_class, entries).where(F.col("n") > 0)
    grand = F.sum(F.col("n") * F.col("m")).over(Window.partitionBy("feature")) / F.sum("n").over(
        Window.partitionBy("feature")
    )
    dev = long.withColumn("_d", F.col("m") - grand)
    sums = dev.groupBy("feature").agg(
        F.sum(F.col("n") * F.col("_d") * F.col("_d")).alias("between"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("total"),
    )
    f = F.try_divide(
        F.try_divide(F.col("between"), F.col("k") - 1), F.try_divide(F.col("within"), F.col("total") - F.col("k"))
    )
    return sums.select("feature", f.alias("score"))


def f_regression(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """F of the univariate regression of the target on each feature."""
    aggs = [
        e
        for i, c in enumerate(columns)
        for e in (
            F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(f"r{i}"),
            F.count_if(F.col(c).isNotNull() & F.col(target).isNotNull()).alias(f"n{i}"),
        )
    ]
    entries = [
        F.struct(
            F.lit(c).alias("feature"),
            F.try_divide(
                F.pow(F.col(f"r{i}"), F.lit(2.0)) * (F.col(f"n{i}") - 2), 1.0 - F.pow(F.col(f"r{i}"), F.lit(2.0))
            ).alias("score"),
        )
        for i, c in enumerate(columns)
    ]
    return _explode(df.agg(*aggs), entries)


def chi2_scores(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Chi-square of non-negative features: class sums against the class share of the total sum."""
    per_class = df.groupBy(target).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(columns)]
    )
    entries = [F.struct(F.lit(c).alias("feature"), F.col(f"s{i}").alias("s")) for i, c in enumerate(columns)]
    long = per_class.select("n", F.explode(F.array(*entries)).alias("_e")).select("n", "_e.*")
    over = Window.partitionBy("feature")
    expected = F.col("n") / F.sum("n").over(over) * F.sum("s").over(over)
    parts = long.select("feature", F.try_divide(F.pow(F.col("s") - expected, F.lit(2.0)), expected).alias("t"))
    return parts.groupBy("feature").agg(F.sum("t").alias("score"))


def interaction_scores(df: DataFrame, columns: Sequence[str], target: str, top: int = 20) -> DataFrame:
    """F of every pairwise product, best first."""
    products = {f"{a} {b}": F.col(a) * F.col(b) for a, b in combinations(columns, 2)}
    scores = anova_f(df, [], target, products)
    return scores.orderBy(F.desc_nulls_last("score"), "feature").limit(top)


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlation of every pair over the rows where both are known, in one aggregation."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    entries = [
        F.struct(F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2"), F.col(f"_{i}").alias("correlation"))
        for i, (a, b) in enumerate(pairs)
    ]
    return _explode(row, entries)


def high_correlations(df: DataFrame, columns: Sequence[str], threshold: float = 0.8) -> DataFrame:
    """Pairs whose absolute correlation exceeds the threshold, strongest first."""
    found = correlations(df, columns).where(F.abs("correlation") > threshold)
    return found.orderBy(F.desc(F.abs("correlation")))


def variance_inflation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Variance inflation without an intercept, from the Gram matrix (columns x columns on the driver)."""
    full = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    index = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = full.agg(*[F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"_{i}_{j}") for i, j in index]).first()
    gram = np.zeros((len(columns), len(columns)))
    for i, j in index:
        gram[i, j] = gram[j, i] = row[f"_{i}_{j}"] or 0.0
    inverse = np.linalg.pinv(gram)
    rows = [(c, float(gram[i, i] * inverse[i, i])) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "feature string, vif double").orderBy(F.desc("vif"))


def select_best(scores: DataFrame, k: int | None = None, share: float | None = None) -> DataFrame:
    """The k best features, or the best share of them."""
    if k is None:
        k = max(1, int(scores.count() * share))
    return scores.orderBy(F.desc_nulls_last("score"), "feature").limit(k)
