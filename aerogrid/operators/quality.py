"""Data quality checks.  Each check is one aggregation and returns a small table of findings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerogrid.functions.num import numeric_columns
from aerogrid.functions.timefeat import epoch_us, floor_time
from aerogrid.operators.ordering import over_series
from aerogrid.operators.prep import quantiles

FINDING = "check string, column string, severity string, n long"

# Ranges a weather observation must keep.
WEATHER_RULES = {
    "temperature": {"min": -60, "max": 60},
    "dewpoint": {"min": -60, "max": 50},
    "pressure": {"min": 850, "max": 1100},
    "wind_speed": {"min": 0, "max": 200},
    "wind_direction": {"min": 0, "max": 360},
    "visibility": {"min": 0, "max": 100000},
    "ceiling": {"min": 0, "max": 60000},
}
# Which actual types satisfy an expected type family.
TYPE_FAMILIES = {
    "float": {"float", "double", "int", "bigint", "smallint", "tinyint"},
    "int": {"int", "bigint", "smallint", "tinyint"},
    "object": {"string"},
    "datetime": {"timestamp", "timestamp_ntz"},
}


def _long(row: DataFrame, findings: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """One-row aggregate to one row per finding; entries are (check, column, severity, source column)."""
    entries = [
        F.struct(
            F.lit(check).alias("check"),
            F.lit(column).alias("column"),
            F.lit(severity).alias("severity"),
            F.col(source).cast("long").alias("n"),
        )
        for check, column, severity, source in findings
    ]
    return row.select(F.explode(F.array(*entries)).alias("_e")).select("_e.*")


def check_schema(df: DataFrame, required: Sequence[str], types: dict[str, str]) -> DataFrame:
    """Missing required columns (error) and columns outside their type family (warning)."""
    actual = dict(df.dtypes)
    rows = [("required", c, "error", 1) for c in sorted(set(required) - set(df.columns))]
    for c, family in sorted(types.items()):
        if c in actual and actual[c] not in TYPE_FAMILIES.get(family, {family}):
            rows.append(("type", c, "warning", 1))
    return df.sparkSession.createDataFrame(rows, FINDING)


def check_constraints(df: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """Values below min, above max, outside the allowed list (missing counts), or missing: n per rule."""
    aggs: list[Column] = []
    findings = []
    for c, rule in rules.items():
        if c not in df.columns:
            continue
        x = F.col(c)
        tests = []
        if "min" in rule:
            tests.append(("below_min", "warning", x < F.lit(rule["min"])))
        if "max" in rule:
            tests.append(("above_max", "warning", x > F.lit(rule["max"])))
        if "values" in rule:
            tests.append(("not_allowed", "warning", ~F.coalesce(x.isin(list(rule["values"])), F.lit(False))))
        if rule.get("not_null"):
            tests.append(("null", "error", x.isNull()))
        for name, severity, cond in tests:
            source = f"_{len(findings)}"
            aggs.append(F.count_if(cond).alias(source))
            findings.append((name, c, severity, source))
    return _long(df.agg(*aggs), findings)


def invalid_values(df: DataFrame, column: str, allowed: Sequence, top: int = 5) -> DataFrame:
    """The first few distinct invalid values, in order."""
    bad = ~F.coalesce(F.col(column).isin(list(allowed)), F.lit(False))
    return df.where(bad).select(column).distinct().orderBy(F.asc_nulls_last(column)).limit(top)


def derive_rules(df: DataFrame) -> DataFrame:
    """Type, extremes and nullability of every numeric column, from the data."""
    names = numeric_columns(df)
    types = dict(df.dtypes)
    aggs = [
        e
        for i, c in enumerate(names)
        for e in (
            F.min(F.col(c).cast("double")).alias(f"lo{i}"),
            F.max(F.col(c).cast("double")).alias(f"hi{i}"),
            F.count_if(F.col(c).isNull()).alias(f"n{i}"),
        )
    ]
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(types[c]).alias("type"),
            F.col(f"lo{i}").alias("min_value"),
            F.col(f"hi{i}").alias("max_value"),
            (F.col(f"n{i}") == 0).alias("not_null"),
        )
        for i, c in enumerate(names)
    ]
    return df.agg(*aggs).select(F.explode(F.array(*entries)).alias("_e")).select("_e.*")


def missing_by_column(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing count and ratio per column and over all columns."""
    columns = list(columns or df.columns)
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(columns)])
    total = reduce(lambda a, b: a + b, [F.col(f"_{i}") for i in range(len(columns))])
    entries = [
        F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("missing"), F.try_divide(F.col(f"_{i}"), F.col("_n")).alias("ratio"))
        for i, c in enumerate(columns)
    ]
    entries.append(
        F.struct(
            F.lit("(all)").alias("column"), total.alias("missing"), F.try_divide(total, F.col("_n") * len(columns)).alias("ratio")
        )
    )
    return row.select(F.explode(F.array(*entries)).alias("_e")).select("_e.*")


def missing_pattern(df: DataFrame, columns: Sequence[str], ts: str = "ts") -> DataFrame:
    """Mean and sample deviation of the missing values per hour; hours without rows count as zero."""
    missing = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("long") for c in columns])
    hours = df.groupBy(floor_time(ts, 60).alias("_h")).agg(F.sum(missing).alias("_m"))
    span = (epoch_us(F.max("_h")) - epoch_us(F.min("_h"))) / F.lit(3_600_000_000) + 1
    row = hours.agg(
        span.cast("long").alias("hours"),
        F.sum("_m").cast("double").alias("_s"),
        F.sum(F.col("_m") * F.col("_m")).cast("double").alias("_q"),
    )
    mean = F.try_divide(F.col("_s"), F.col("hours"))
    std = F.sqrt(F.try_divide(F.col("_q") - F.col("_s") * mean, F.col("hours") - 1))
    return row.select("hours", mean.alias("mean_missing"), std.alias("std_missing"), (std > mean).alias("non_uniform"))


def duplicates(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Rows, rows beyond the first of each group of equal rows (or equal keys), and their ratio."""
    keys = list(keys or df.columns)
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    return groups.agg(F.sum("_c").alias("rows"), F.sum(F.col("_c") - 1).alias("duplicates")).withColumn(
        "ratio", F.try_divide(F.col("duplicates"), F.col("rows"))
    )


def consistency(df: DataFrame, temp: str, dew: str, wind: str, gust: str) -> DataFrame:
    """Rows with the temperature below the dewpoint and with gusts below the wind."""
    row = df.agg(
        F.count_if(F.col(temp) < F.col(dew)).alias("_0"), F.count_if(F.col(gust) < F.col(wind)).alias("_1")
    )
    return _long(row, [("temperature_below_dewpoint", temp, "warning", "_0"), ("gust_below_wind", gust, "warning", "_1")])


def zscore_counts(df: DataFrame, columns: Sequence[str], limit: float = 3.0) -> DataFrame:
    """Values more than `limit` population deviations from the mean, per column."""
    stats = df.agg(
        *[e for c in columns for e in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]
    ).first()
    aggs = []
    for i, c in enumerate(columns):
        m, s = stats[f"m_{c}"], stats[f"s_{c}"]
        cond = F.abs((F.col(c) - F.lit(m)) / F.lit(s)) > F.lit(limit) if s else F.lit(False)
        aggs.append(F.count_if(cond).alias(f"_{i}"))
    return _long(df.agg(*aggs), [("zscore", c, "warning", f"_{i}") for i, c in enumerate(columns)])


def vote(flags: Sequence[str | Column]) -> Column:
    """1 where more than half of the detector flags are set."""
    total = reduce(lambda a, b: a + b, [(F.col(f) if isinstance(f, str) else f).cast("double") for f in flags])
    return (total / F.lit(float(len(flags))) > 0.5).cast("int")


def explain_anomalies(df: DataFrame, flag_column: str, columns: Sequence[str], key: str, top: int = 3) -> DataFrame:
    """Most unusual features (sample z above 2, at most `top`) and the kind of each flagged row."""
    stats = df.agg(
        *[e for c in columns for e in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))]
    ).first()
    limits = quantiles(df, columns, [0.01, 0.99])
    zs, extremes = [], []
    for c in columns:
        m, s = stats[f"m_{c}"], stats[f"s_{c}"]
        z = F.abs((F.col(c) - F.lit(m)) / F.lit(s)) if s else F.lit(None).cast("double")
        zs.append(F.when(z > 2.0, F.struct((-z).alias("rank"), F.lit(c).alias("feature"))))
        lo, hi = limits[c]
        extremes.append(F.when(F.col(c) < lo, f"{c}_very_low").when(F.col(c) > hi, f"{c}_very_high"))
    unusual = F.slice(F.sort_array(F.array_compact(F.array(*zs))), 1, top)
    found = F.array_compact(F.array(*extremes))
    kind = (
        F.when(F.size(found) >= 3, "multivariate_extreme")
        .when(F.size(found) > 0, F.concat(F.lit("extreme_"), F.try_element_at(found, F.lit(1))))
        .otherwise("subtle_anomaly")
    )
    return df.where(F.col(flag_column) == 1).select(
        key,
        F.transform(unusual, lambda x: x["feature"]).alias("unusual_features"),
        F.transform(unusual, lambda x: -x["rank"]).alias("unusual_scores"),
        kind.alias("anomaly_type"),
    )


def completeness(df: DataFrame, minutes: int = 30, ts: str = "ts") -> DataFrame:
    span = (epoch_us(F.max(ts)) - epoch_us(F.min(ts))).cast("double") / F.lit(minutes * 60_000_000.0)
    return df.agg(F.try_divide(F.count(F.lit(1)).cast("double"), span).alias("completeness"))


def validation_report(
    df: DataFrame, rules: dict[str, dict], required: Sequence[str], types: dict[str, str], keys: Sequence[str]
) -> DataFrame:
    """All checks as one findings table; rows with n = 0 are checks that passed."""
    numbers = numeric_columns(df, {"event_id"})
    row = duplicates(df, keys)
    exact = duplicates(df)
    missing = missing_by_column(df).where(F.col("column") != "(all)")
    gaps = over_series(
        df,
        lambda w: [(epoch_us("ts") - F.lag(epoch_us("ts")).over(w)).alias("_gap")],
        back=1,
        keep=["station"],
    ).agg(F.count_if(F.col("_gap") > F.lit(24 * 3_600_000_000)).alias("_0"))
    parts = [
        check_schema(df, required, types),
        check_constraints(df, rules),
        zscore_counts(df, numbers),
        consistency(df, "temperature_c", "dewpoint_c", "wind_speed_kt", "wind_gust_kt"),
        _long(row, [("duplicate_key", ",".join(keys), "error", "duplicates")]),
        _long(
            exact.withColumn("_0", F.when(F.col("ratio") > 0.1, F.col("duplicates")).otherwise(0)),
            [("duplicate_row", "(all)", "warning", "_0")],
        ),
        missing.select(
            F.lit("mostly_missing").alias("check"),
            "column",
            F.lit("warning").alias("severity"),
            F.when(F.col("ratio") > 0.5, F.col("missing")).otherwise(0).cast("long").alias("n"),
        ),
        _long(gaps, [("gap_over_24h", "ts", "warning", "_0")]),
        _long(
            completeness(df).select((F.col("completeness") < 0.8).cast("long").alias("_0")),
            [("low_completeness", "ts", "warning", "_0")],
        ),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def report_summary(report: DataFrame) -> DataFrame:
    """Number of failed checks per severity and whether the data is valid."""
    return report.agg(
        F.count_if((F.col("severity") == "error") & (F.col("n") > 0)).alias("errors"),
        F.count_if((F.col("severity") == "warning") & (F.col("n") > 0)).alias("warnings"),
    ).withColumn("is_valid", F.col("errors") == 0)
