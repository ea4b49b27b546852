"""File sources and sinks: observation, forecast and restriction files, feature tables, report dumps.

Readers state their schema, give malformed rows as a table of their own, and leave filters to the
scan: Parquet filters push down, and a table written by `save_features(partition_by=...)` prunes folders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerogrid.functions import text as T
from aerogrid.operators.filters import filter_dates, with_weather_flag

OBSERVATION_SCHEMA = "datetime TIMESTAMP_NTZ, report STRING, _corrupt_record STRING"
FORECAST_SCHEMA = "issue_time TIMESTAMP_NTZ, valid_from TIMESTAMP_NTZ, valid_to TIMESTAMP_NTZ, report STRING, _corrupt_record STRING"
RAW_INTERVAL_SCHEMA = (
    "`Protected Location Id` STRING, `Protected Location Type` STRING, `Regulation Start Time` TIMESTAMP_NTZ, "
    "`Regulation End Date` TIMESTAMP_NTZ, `Regulation Cancel Status` STRING, `Regulation Reason Name` STRING, "
    "`Regulation Description` STRING, `Regulation Duration (min)` BIGINT, `ATFM Delay (min)` BIGINT, "
    "`Regulated Traffic` BIGINT"
)
WINDOW_SCHEMA = (
    "airport STRING, start TIMESTAMP_NTZ, end TIMESTAMP_NTZ, regulation_start TIMESTAMP_NTZ, "
    "regulation_end TIMESTAMP_NTZ, reason STRING, duration_hours DOUBLE"
)

FALLBACK = "ISO-8859-1"  # of files that are not in UTF-8

# Date forms a file name may carry.
NAME_DATES = [r"(\d{4})-(\d{2})-(\d{2})", r"(\d{4})(\d{2})(\d{2})", r"(\d{4})_(\d{2})_(\d{2})"]


# ---------------------------------------------------------------- restriction intervals


def canonical_intervals(raw: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Raw export columns under library names, with the cancellation status as a boolean."""
    return raw.select(
        F.col("`Protected Location Id`").alias("station"),
        F.col("`Protected Location Type`").alias("location_type"),
        F.col("`Regulation Start Time`").cast("timestamp_ntz").alias("start_time"),
        F.col("`Regulation End Date`").cast("timestamp_ntz").alias("end_time"),
        F.col("`Regulation Reason Name`").alias("reason"),
        F.col("`Regulation Description`").alias("description"),
        F.col("`Regulation Duration (min)`").alias("duration_min"),
        F.col("`ATFM Delay (min)`").alias("delay_min"),
        F.col("`Regulated Traffic`").alias("regulated_traffic"),
        (F.col("`Regulation Cancel Status`") == "Cancelled").alias("cancelled"),
        *extra,
    )


def select_intervals(df: DataFrame, stations: Sequence[str] | None, start, end) -> DataFrame:
    """Intervals of the given stations (None: all) that start in the closed range, with the weather flag."""
    picked = df if stations is None else df.where(F.col("station").isin(list(stations)))
    return with_weather_flag(filter_dates(picked, "start_time", start, end))


def read_intervals(spark: SparkSession, path: str, stations: Sequence[str] | None, start, end, fmt: str = "csv") -> DataFrame:
    """Read a raw interval export (CSV or Parquet) and select from it."""
    if fmt == "csv":
        raw = spark.read.schema(RAW_INTERVAL_SCHEMA).option("header", True).csv(path)
    else:
        raw = spark.read.parquet(path)
    return select_intervals(canonical_intervals(raw), stations, start, end)


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """Sampling windows from CSV."""
    return spark.read.schema(WINDOW_SCHEMA).option("header", True).csv(path)


# ---------------------------------------------------------------- observations and forecasts


def name_date(path: Column | str) -> Column:
    """Date in a file name, null if it has none or the digits are no date."""
    name = F.element_at(F.split(path if isinstance(path, Column) else F.col(path), "/"), -1)
    dates = [
        F.try_make_timestamp_ntz(
            *[F.nullif(F.regexp_extract(name, p, i), F.lit("")).cast("int") for i in (1, 2, 3)],
            F.lit(0),
            F.lit(0),
            F.lit(0).cast("decimal(8,6)"),
        )
        for p in NAME_DATES
    ]
    return F.coalesce(*dates).cast("date")


def in_name_range(path: Column | str, start, end) -> Column:
    """Keep files whose name date lies in the range.  A name without digits for a date is dropped; one
    whose digits are no date is kept."""
    c = path if isinstance(path, Column) else F.col(path)
    name = F.element_at(F.split(c, "/"), -1)
    has_digits = None
    for p in NAME_DATES:
        has_digits = name.rlike(p) if has_digits is None else has_digits | name.rlike(p)
    date = name_date(c)
    return has_digits & (date.isNull() | date.between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def _station_of(path: Column) -> Column:
    """Station of a file: .../<station>/<file> or .../station=<station>/<file>."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -2), "^station=", "")


def _read_reports(spark: SparkSession, paths, schema: str, encoding: str, start, end, by_name: bool) -> DataFrame:
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("encoding", encoding)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .csv(paths)
    )
    path = F.col("_metadata.file_path")
    folder = [] if "station" in df.columns else [_station_of(path).alias("station")]
    df = df.select("*", *folder, F.col("_metadata.file_name").alias("source_file"), path.alias("_path"))
    if by_name:
        df = df.where(in_name_range("_path", start, end))
    return df.drop("_path")


def _lines(spark: SparkSession, paths) -> DataFrame:
    return spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("source_file"))


def files_by_encoding(spark: SparkSession, paths, fallback: str = FALLBACK) -> DataFrame:
    """(path, encoding) of each file that has lines: UTF-8 where all its lines are, else the fallback."""
    utf8 = F.bool_and(F.is_valid_utf8("value"))
    return _lines(spark, paths).groupBy(F.col("_path").alias("path")).agg(F.when(utf8, "UTF-8").otherwise(fallback).alias("encoding"))


def _column_names(schema: str) -> list[str]:
    return [part.split()[0].strip("`") for part in schema.split(", ")]


def _read_lines(spark: SparkSession, paths, schema: str, fallback: str) -> DataFrame:
    """Rows of CSV files in mixed encodings: the columns of the schema, station, source_file.

    Lines are read as they stand.  A file whose lines are all valid UTF-8 is in UTF-8, any other in the fallback
    encoding; only the paths of those others are joined to the lines, so no file is held as a whole.
    """
    lines = _lines(spark, paths)
    others = lines.where(~F.is_valid_utf8("value")).select("_path").distinct().withColumn("_other", F.lit(True))
    known = lines.join(others, "_path", "left")
    text = F.when(F.col("_other"), F.decode(F.col("value").cast("binary"), fallback)).otherwise(F.col("value"))
    names = [n for n in _column_names(schema) if n != "_corrupt_record"]
    header = F.regexp_replace("_line", '"', "") == ",".join(names)
    parsed = F.from_csv("_line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = known.select(text.alias("_line"), "_path", "source_file").where((F.col("_line") != "") & ~header)
    return rows.select(parsed.alias("_row"), _station_of(F.col("_path")).alias("station"), "source_file", "_path").select("_row.*", "station", "source_file", "_path")


def malformed_rows(spark: SparkSession, root: str, schema: str = OBSERVATION_SCHEMA, encoding: str = "UTF-8") -> DataFrame:
    """The rows below `root` that do not fit the schema: source_file, line as it stands, and what could be read of it.

    The readers leave these rows out, as they have no date to be selected by.  `encoding` "auto" is that of `read_observations`.
    """
    if encoding == "auto":
        rows = _read_lines(spark, root, schema, FALLBACK).drop("_path")
    else:
        rows = _read_reports(spark, root, schema, encoding, None, None, False)
    return rows.where(F.col("_corrupt_record").isNotNull()).withColumnRenamed("_corrupt_record", "line")


def _folders(root: str, stations: Sequence[str] | None, layout: str) -> list[str]:
    """The folders of the given stations, or of all there are."""
    return [f"{root}/{layout.format(station=s)}" for s in stations] if stations is not None else [f"{root}/{layout.format(station='*')}"]


def _read_stations(spark: SparkSession, root: str, stations: Sequence[str] | None, layout: str, schema: str, encoding: str, start, end, by_name: bool) -> DataFrame:
    """Rows of the given stations (None: all) by the station of their folder or, in a layout that names none, by their first column `station`."""
    if "{station}" in layout:
        return _read_reports(spark, _folders(root, stations, layout), schema, encoding, start, end, by_name)
    rows = _read_reports(spark, f"{root}/{layout}", f"station STRING, {schema}", encoding, start, end, by_name)
    return rows if stations is None else rows.where(F.col("station").isin(list(stations)))


def read_observations(
    spark: SparkSession,
    root: str,
    stations: Sequence[str] | None,
    start,
    end,
    encoding: str = "UTF-8",
    by_name: bool = False,
    layout: str = "{station}",
) -> DataFrame:
    """Decoded observations of several stations (None: all) from <root>/<station folder>/*.csv in the closed date range.

    `layout` gives the station folder (`station={station}` for a partitioned layout), or for files of many stations,
    which name them in a first column, their folders (`group=*`): a folder per station does not go on for thousands of
    stations.  `by_name` also prunes files by the date in their name.  `encoding` "auto", of station folders only, reads each file as UTF-8 or, if its bytes are not, as
    ISO-8859-1; any other name holds for all files.  Rows that do not fit are in `malformed_rows`.
    """
    if encoding == "auto":
        rows = _read_lines(spark, _folders(root, stations, layout), OBSERVATION_SCHEMA, FALLBACK)
        rows = (rows.where(in_name_range("_path", start, end)) if by_name else rows).drop("_path")
    else:
        rows = _read_stations(spark, root, stations, layout, OBSERVATION_SCHEMA, encoding, start, end, by_name)
    rows = filter_dates(rows.withColumnRenamed("datetime", "ts"), "ts", start, end)
    return rows.select(
        "station", "ts", "source_file", "report", *T.decode_report("report"), *T.phenomenon_flags("report")
    )


def read_forecasts(
    spark: SparkSession,
    root: str,
    stations: Sequence[str] | None,
    start,
    end,
    encoding: str = "UTF-8",
    by_name: bool = False,
    layout: str = "{station}",
) -> DataFrame:
    """Forecast periods of several stations (None: all), filtered on the start of validity; `layout` as for observations."""
    rows = _read_stations(spark, root, stations, layout, FORECAST_SCHEMA, encoding, start, end, by_name)
    rows = filter_dates(rows, "valid_from", start, end)
    return rows.select("station", "issue_time", "valid_from", "valid_to", "source_file", *T.decode_report("report"))


def forecast_periods(df: DataFrame, report: str = "report", issue: str = "issue_time") -> DataFrame:
    """Main validity period of each forecast report as rows; days are those of the issue month."""
    c = F.col(report)
    groups = F.regexp_extract_all(c, F.lit(T.VALIDITY_GROUP), F.lit(0))
    period = F.explode(F.slice(groups, 1, 1))
    month = F.date_trunc("month", F.col(issue)).cast("timestamp_ntz")

    def moment(at: int) -> Column:
        day = F.substring("period", at, 2).cast("int")
        hour = F.substring("period", at + 2, 2).cast("int")
        shifted = month + F.make_dt_interval(day - 1, hour)
        return F.when(shifted < F.col(issue) - F.expr("INTERVAL 15 DAYS"), F.add_months(shifted, 1).cast("timestamp_ntz")
                      + F.make_dt_interval(F.lit(0), hour)).otherwise(shifted)

    rows = df.withColumn("period", period)
    return rows.select(
        *df.columns,
        moment(1).alias("valid_from"),
        moment(6).alias("valid_to"),
        F.lit("MAIN").alias("change_type"),
        *T.decode_report(report),
    )


def reports_from_parts(df: DataFrame) -> DataFrame:
    """Report dump with year, month, day, hour and minute columns: build the time, keep METAR rows."""
    made = F.try_make_timestamp_ntz(
        F.col("year"), F.col("month"), F.col("day"), F.col("hour"), F.col("minute"), F.lit(0).cast("decimal(8,6)")
    )
    return df.where(F.col("report").contains("METAR")).withColumn("ts", made)


def read_wrapped_reports(spark: SparkSession, path: str) -> DataFrame:
    """Forecast dump whose reports wrap over lines and end with '='; each starts with a 12-digit time."""
    text = spark.read.option("lineSep", "=").text(path)  # one row per report, however it wraps
    joined = F.trim(F.regexp_replace("value", r"\s+", " "))
    return (
        text.select(joined.alias("line"))
        .where(F.col("line").rlike(r"^\d{12} "))
        .select(
            F.to_timestamp_ntz(F.substring("line", 1, 12), F.lit("yyyyMMddHHmm")).alias("issue_time"),
            F.expr("substring(line, 14)").alias("report"),
        )
    )


# ---------------------------------------------------------------- feature tables


def save_features(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Write a feature table; partition by a date column to let later reads prune."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def load_features(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """Read a feature table; CSV needs its schema."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "csv":
        if schema is None:
            raise ValueError("give the schema of a CSV feature table")
        return spark.read.schema(schema).option("header", True).csv(path)
    raise ValueError(f"unknown format {fmt}")


def with_obs_date(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Add the partition column of the Parquet layout."""
    return df.withColumn("obs_date", F.to_date(ts))


