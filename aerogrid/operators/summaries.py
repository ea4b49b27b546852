"""Descriptive summaries: station statistics, shares, histograms, boxes, dataset facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerogrid.functions.num import numeric_columns
from aerogrid.operators.ordering import exact_quantiles
from aerogrid.session import settle


def station_statistics(intervals: DataFrame) -> DataFrame:
    """Per station: total, active and cancelled intervals, date range, mean duration and delay of the active."""
    active = ~F.col("cancelled")
    total = F.count(F.lit(1))
    return intervals.groupBy("station").agg(
        total.alias("total"),
        F.count_if(active).alias("active"),
        F.count_if(F.col("cancelled")).alias("cancelled"),
        (F.count_if(F.col("cancelled")) / total * 100.0).alias("cancel_rate"),
        F.min("start_time").alias("first_start"),
        F.max("start_time").alias("last_start"),
        F.coalesce(F.avg(F.when(active, F.col("duration_min"))), F.lit(0.0)).alias("avg_duration_min"),
        F.coalesce(F.sum(F.when(active, F.col("delay_min"))), F.lit(0)).alias("total_delay_min"),
    )


def value_shares(df: DataFrame, column: str, by: Sequence[str] = (), top: int | None = None) -> DataFrame:
    """Count and share of each value, of all rows or within `by`; optionally the most frequent ones."""
    counts = df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    counts = settle(counts)  # one row per value, read twice
    if by:
        keyed = counts.withColumn("_key", F.struct(*by))
        totals = keyed.groupBy("_key").agg(F.sum("n").alias("_total"))
        with_total = keyed.join(totals, "_key")
    else:
        with_total = counts.withColumn("_total", F.lit(counts.agg(F.sum("n")).first()[0]))
    out = with_total.select(*by, column, "n", (F.col("n") / F.col("_total") * 100.0).alias("share"))
    return out if top is None else out.orderBy(F.desc("n"), F.asc_nulls_last(column)).limit(top)


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles per column."""
    row = df.agg(
        *[
            e
            for i, c in enumerate(columns)
            for e in (F.count(c).alias(f"n{i}"), F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}"))
        ]
    )
    entries = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(f"n{i}").alias("count"),
            F.col(f"m{i}").alias("mean"),
            F.col(f"s{i}").alias("std"),
        )
        for i, c in enumerate(columns)
    ]
    moments = row.select(F.explode(F.array(*entries)).alias("_e")).select("_e.*")
    qs = exact_quantiles(df, columns, [0.0, 0.25, 0.5, 0.75, 1.0])
    names = ["min", "q25", "median", "q75", "max"]
    return moments.join(qs.select("feature", *[F.col(f"q{i}").alias(n) for i, n in enumerate(names)]), "feature")


def histogram(df: DataFrame, column: str, bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Counts in equal-width bins between the extremes; the last bin is closed."""
    row = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    if row["lo"] is None:
        return df.select(*by).where(F.lit(False)).withColumns({"bin": F.lit(0), "bin_start": F.lit(0.0), "n": F.lit(0)})
    lo, hi = float(row["lo"]), float(row["hi"])
    width = (hi - lo) / bins or 1.0 / bins
    index = F.least(F.floor((F.col(column) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("bin_start", F.lit(lo) + F.col("bin") * F.lit(width))


def box_summary(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """Five-number summary per class."""
    qs = exact_quantiles(df, [column], [0.0, 0.25, 0.5, 0.75, 1.0], by)
    names = ["lowest", "q25", "median", "q75", "highest"]
    return qs.select(*by, "n", *[F.col(f"q{i}").alias(n) for i, n in enumerate(names)])


def feature_report(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Type and number of distinct values per feature."""
    types = dict(df.dtypes)
    count = F.approx_count_distinct if approximate else F.count_distinct
    row = df.agg(*[count(c).alias(f"_{i}") for i, c in enumerate(columns)])
    numbers = set(numeric_columns(df))
    entries = [
        F.struct(
            F.lit(c).alias("feature"),
            F.lit("numerical" if c in numbers else "categorical").alias("kind"),
            F.lit(types[c]).alias("type"),
            F.col(f"_{i}").alias("distinct_values"),
        )
        for i, c in enumerate(columns)
    ]
    return row.select(F.explode(F.array(*entries)).alias("_e")).select("_e.*")


def dataset_summary(df: DataFrame, columns: Sequence[str], ts: str = "ts") -> DataFrame:
    """Rows, columns, time range and share of missing cells."""
    missing: Column = F.lit(0).cast("long")
    for c in columns:
        missing = missing + F.count_if(F.col(c).isNull())
    rows = F.count(F.lit(1))
    return df.agg(
        rows.alias("rows"),
        F.lit(len(columns)).alias("columns"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        F.try_divide(missing, rows * len(columns)).alias("missing_ratio"),
    )


def content_hash(df: DataFrame) -> DataFrame:
    """Order-free hash of the content: equal tables give equal values however they are partitioned."""
    names = sorted(df.columns)
    h = F.xxhash64(*[e for c in names for e in (F.col(c).isNull(), F.col(c))])  # nulls alone leave a hash as it is
    total = F.sum(h.cast("decimal(20,0)"))  # pairs of equal rows cancel out in the exclusive or
    return df.agg(F.bit_xor(h).alias("hash_xor"), total.alias("hash_sum"), F.count(F.lit(1)).alias("rows"))
