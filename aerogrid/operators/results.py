"""Tables of tuning trials and experiment results: storing, comparing, ranking, rolling up."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerogrid.operators.ordering import accumulate, hash_order, with_ranges

MODEL_RESULT = (
    "model_id string, experiment_id string, model string, model_type string, stored_at timestamp_ntz, "
    "metrics map<string,double>, confusion array<array<bigint>>, importances array<struct<feature:string,importance:double>>, "
    "config map<string,string>, training_time double, error string"
)


# ---------------------------------------------------------------- storing


def append_results(rows: DataFrame, path: str) -> None:
    """Append result rows to the Parquet result table; its index is a projection of it."""
    rows.write.mode("append").parquet(path)


def load_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def export_results(results: DataFrame, path: str, fmt: str = "csv") -> None:
    """Export a flat comparison table."""
    writer = results.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.json(path)


def newest_first(results: DataFrame, when: str, condition: Column | None = None, tie: str | None = None) -> DataFrame:
    """Filtered listing, newest first."""
    picked = results if condition is None else results.where(condition)
    return picked.orderBy(F.desc(when), *([tie] if tie else []))


def split_retention(results: DataFrame, day: str, today, days: int) -> tuple[DataFrame, DataFrame]:
    """Rows to keep and rows to remove: a row goes when it is older than `days`."""
    limit = F.date_sub(F.lit(today).cast("date"), days)
    return results.where(F.col(day) >= limit), results.where(F.col(day) < limit)


# ---------------------------------------------------------------- comparing


def compare(results: DataFrame, rows: str, columns: str, metric: str, values: Sequence[str]) -> DataFrame:
    """Mean metric per model and experiment as a pivot table with known columns."""
    return results.groupBy(rows).pivot(columns, list(values)).agg(F.avg(metric))


def best_rows(results: DataFrame, metric: str, n: int, tie: str) -> DataFrame:
    """Best n rows by a metric; rows without it are left out (top-k, no full sort)."""
    return results.where(F.col(metric).isNotNull()).orderBy(F.desc(metric), tie).limit(n)


def top_per_group(df: DataFrame, group: str, metric: str, n: int, tie: str) -> DataFrame:
    """Best n rows of each group.  Spark keeps only n rows per group and task before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last(metric), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def experiment_rollup(results: DataFrame, experiment: str, model: str, metric: str, time: str) -> DataFrame:
    """Best model, best and mean metric and total time per experiment."""
    known = F.when(F.col(metric).isNotNull(), F.struct(metric, model))
    return results.groupBy(experiment).agg(
        F.max(known)[model].alias("best_model"),
        F.max(metric).alias("best_score"),
        F.avg(metric).alias("mean_score"),
        F.sum(time).alias("total_time"),
    )


def rank_models(results: DataFrame, group: Sequence[str], metric: str, tie: str) -> DataFrame:
    """Rank 1..n per experiment, best first; missing metrics last.  Only equal metrics meet in a task."""
    placed = rank_scores(results, group, metric).withColumnRenamed("rank", "_first").withColumn("_group", F.struct(*group))
    known = results.groupBy(F.struct(*group).alias("_group")).agg((F.count(metric) + 1).alias("_missing"))
    among = F.row_number().over(Window.partitionBy("_group", metric).orderBy(tie))
    first = F.coalesce("_first", "_missing")
    return placed.join(known, "_group").select(*results.columns, (first + among - 1).cast("int").alias("rank"))


def rank_scores(results: DataFrame, group: Sequence[str], metric: str) -> DataFrame:
    """Competition rank of each row by its metric, without sorting a group in one task."""
    ranged, names = with_ranges(results.where(F.col(metric).isNotNull()), [metric])
    cells = ranged.groupBy(*group, F.col(names[metric]).alias("_r"), metric).agg(F.count(F.lit(1)).alias("_n"))
    cum = accumulate(cells, group, metric, ["_n"], descending=True, strict=True)
    ranks = cum.select(*group, metric, (F.col("_n_cum") + 1).alias("rank"))
    return results.join(ranks, [*group, metric], "left")


def long_metrics(results: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per result and metric."""
    return results.unpivot(list(ids), list(metrics), "metric", "value")


def suite_summary(results: DataFrame, label: str, metrics: Sequence[str]) -> DataFrame:
    """Best, mean and sample deviation of each metric and the first row that reaches the best."""
    long = long_metrics(results, [label], metrics).where(F.col("value").isNotNull())
    best = F.max_by(F.struct(label, "value"), F.struct(F.col("value"), -F.col(label)))
    return (
        long.groupBy("metric")
        .agg(best.alias("b"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
        .select("metric", F.col("b.value").alias("best"), "mean", "std", F.col(f"b.{label}").alias("best_row"))
    )


def spread_by(results: DataFrame, by: str, metric: str) -> DataFrame:
    """Mean and population deviation of a metric over folds, per training size."""
    return results.groupBy(by).agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"))


def fold_rollup(folds: DataFrame, metrics: Sequence[str], time: str, cells: Sequence[str]) -> DataFrame:
    """Mean and population deviation of the metrics, summed time and summed confusion cells over folds."""
    return folds.agg(
        *[e for m in metrics for e in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))],
        F.sum(time).alias("total_time"),
        *[F.sum(c).alias(c) for c in cells],
    )


def with_status(results: DataFrame, error: str, metric: str, tie: str) -> DataFrame:
    """success / failed status, best metric first, failures last."""
    return results.withColumn("status", F.when(F.col(error).isNull(), "success").otherwise("failed")).orderBy(
        F.desc_nulls_last(metric), tie
    )


# ---------------------------------------------------------------- trials


def parameter_grid(spark: SparkSession, space: dict[str, Sequence]) -> DataFrame:
    """Every combination of the listed values, one row each."""
    names = sorted(space)
    rows = [
        (i, {n: str(v) for n, v in zip(names, values)})
        for i, values in enumerate(itertools.product(*[space[n] for n in names]))
    ]
    return spark.createDataFrame(rows, "trial_id long, params map<string,string>")


def grid_over(df: DataFrame, axes: dict[str, Sequence]) -> DataFrame:
    """Every row combined with every combination of the listed values."""
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def sample_trials(grid: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n trials of a grid, chosen by key hash."""
    return grid.orderBy(hash_order([key], seed), key).limit(n)


def best_so_far(trials: DataFrame, group: Sequence[str], order: str, metric: str) -> DataFrame:
    """Running maximum of the metric in trial order (trial numbers are unique)."""
    ranged, names = with_ranges(trials, [order])
    cells = ranged.select(*group, F.col(names[order]).alias("_r"), order, metric)
    out = accumulate(cells, group, order, [metric], how="max")
    return out.select(*group, order, metric, F.col(f"{metric}_cum").alias("best_so_far"))


def pareto_front(trials: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """Trials no other trial dominates, for two objectives that are both maximised.

    A trial is dominated if a larger first objective comes with at least its second, or an equal first
    with a larger second.  The largest second objective above each first value is a running maximum over
    value ranges, so no pairs of trials are formed.
    """
    known = trials.where(F.col(first).isNotNull() & F.col(second).isNotNull())
    ranged, names = with_ranges(known, [first])
    cells = ranged.groupBy(F.col(names[first]).alias("_r"), first).agg(F.max(second).alias("_top"))
    above = accumulate(cells, [], first, ["_top"], descending=True, how="max", strict=True)
    front = above.where(F.col("_top_cum").isNull() | (F.col("_top") > F.col("_top_cum")))
    limits = front.select(F.col(first), F.col("_top").alias(second))
    found = known.join(limits, [first, second], "left_semi")
    lead = found.agg(F.max(first).alias("_lead"))
    return found.join(F.broadcast(lead), F.lit(True)).select(  # one row on the right
        key, first, second, (F.col(first) == F.col("_lead")).alias("primary_pick")
    )
