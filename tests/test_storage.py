"""Stored days: replaced by later runs, dropped by age, and never half of a run."""

import os

from pyspark.sql import functions as F

from aerogrid.session import scratch_path
from aerogrid.sources import storage


def rows(spark, first, last, value):
    days = spark.range(first, last).select(F.expr("TIMESTAMP_NTZ '2024-01-01 12:00:00'") .alias("_t"), F.col("id"))
    return days.select((F.col("_t") + F.make_dt_interval(F.col("id").cast("int"))).alias("ts"), F.lit(value).alias("v"))


def stored(spark, root, *span):
    found = storage.load_days(spark, root, *span)
    return {} if found is None else {str(r.day): r.v for r in found.collect()}


def test_runs_replace_their_days_and_retention_drops_folders(spark):
    root = scratch_path(spark, "storage")
    assert storage.load_days(spark, root) is None and storage.retain_days(spark, root, "2024-02-01", 1) == []
    storage.store_days(rows(spark, 0, 6, "first"), root)
    storage.store_days(rows(spark, 4, 8, "second"), root)
    assert stored(spark, root) == {f"2024-01-0{i}": "first" if i < 5 else "second" for i in range(1, 9)}
    assert stored(spark, root, "2024-01-04", "2024-01-05") == {"2024-01-04": "first", "2024-01-05": "second"}
    assert storage.retain_days(spark, root, "2024-01-08", 5) == ["2024-01-01", "2024-01-02"]
    assert stored(spark, root) == {f"2024-01-0{i}": "first" if i < 5 else "second" for i in range(3, 9)}
    left = sorted(d for _, ds, _ in os.walk(f"{root.removeprefix('file:')}/runs") for d in ds if d.startswith("day="))
    assert left == [f"day=2024-01-0{i}" for i in range(3, 9)]  # replaced and dropped days are gone


def test_a_run_that_died_is_not_read_and_a_run_under_way_stays(spark):
    root = scratch_path(spark, "storage")
    storage.store_days(rows(spark, 0, 2, "first"), root)
    rows(spark, 0, 2, "dead").withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(f"{root}/runs/dead")
    os.makedirs(f"{root.removeprefix('file:')}/manifest/v=2")  # without its _SUCCESS
    assert set(stored(spark, root).values()) == {"first"}
    storage.retain_days(spark, root, "2024-01-01", 100)
    assert os.path.isdir(f"{root.removeprefix('file:')}/runs/dead/day=2024-01-01")


def test_rows_without_a_time_and_empty_tables(spark):
    root = scratch_path(spark, "storage")
    storage.store_days(rows(spark, 0, 1, "x").unionByName(spark.createDataFrame([(None, "y")], "ts timestamp_ntz, v string")), root)
    storage.store_days(rows(spark, 0, 0, "z"), root)
    assert stored(spark, root) == {"2024-01-01": "x"}
