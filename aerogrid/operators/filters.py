"""Projections and filters on observations and intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerogrid.functions.num import categorical_columns, numeric_columns
from aerogrid.functions.text import is_weather_reason


def filter_equal(df: DataFrame, column: str, value) -> DataFrame:
    """Rows whose column equals a value."""
    return df.where(F.col(column) == F.lit(value))


def filter_dates(df: DataFrame, column: str, start, end) -> DataFrame:
    """Rows whose time lies in the closed range; a plain range predicate, so it reaches the scan."""
    kind = df.schema[column].dataType  # literals of the column's own type keep the predicate on the scan
    return df.where(F.col(column).between(F.lit(start).cast(kind), F.lit(end).cast(kind)))


def usable_intervals(df: DataFrame, min_minutes: float | None = 30, location_type: str | None = "Aerodrome") -> DataFrame:
    """Intervals at aerodromes that were not cancelled and last long enough."""
    if location_type is not None:
        df = df.where(F.col("location_type") == location_type)
    df = df.where(~F.col("cancelled"))
    return df if min_minutes is None else df.where(F.col("duration_min") >= min_minutes)


def with_weather_flag(df: DataFrame) -> DataFrame:
    """Add `is_weather_related`; a table without a reason column is taken as all weather."""
    value = is_weather_reason("reason") if "reason" in df.columns else F.lit(True)
    return df.withColumn("is_weather_related", value)


def weather_at_station(df: DataFrame, station: str, reason: str = "W - Weather") -> DataFrame:
    """Weather intervals at the aerodrome of one station."""
    return df.where(
        (F.col("reason") == reason) & (F.col("location_type") == "Aerodrome") & (F.col("station") == station)
    )


def project_kind(df: DataFrame, kind: str) -> DataFrame:
    """Only the numeric, or only the categorical, columns."""
    names = numeric_columns(df) if kind == "numeric" else categorical_columns(df)
    return df.select(*names)


def missing_shares(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Share of missing values per column; one aggregation, one row to the driver."""
    n, *known = df.agg(F.count(F.lit(1)), *[F.count(F.col(c)) for c in columns]).first()
    return {c: (n - k) / n if n else 0.0 for c, k in zip(columns, known, strict=True)}


def drop_sparse_columns(df: DataFrame, limit: float = 0.5, keep: Sequence[str] = ()) -> DataFrame:
    """Drop the columns of which more than `limit` is missing."""
    candidates = [c for c in df.columns if c not in keep]
    shares = missing_shares(df, candidates)
    return df.select(*[c for c in df.columns if c in keep or shares[c] <= limit])


def final_columns(df: DataFrame, base: Sequence[str], optional: Sequence[str], prefixes: Sequence[str] = ()) -> DataFrame:
    """The fixed columns, then the optional ones and the prefixed indicators that exist."""
    picked: list[str | Column] = list(base)
    picked += [c for c in optional if c in df.columns]
    picked += [c for c in df.columns if any(c.startswith(p) for p in prefixes) and c not in picked]
    return df.select(*picked)
