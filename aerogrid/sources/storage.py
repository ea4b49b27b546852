"""Feature tables kept by day: each run writes its days to a folder of its own, and a manifest says where every day is.

Readers follow the newest manifest, so a run becomes visible at once and as a whole, days it brings replace those of
earlier runs, and a run that dies leaves nothing behind that is read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = "day"
_MANIFEST = "day DATE, path STRING"


def _versions(spark: SparkSession, root: str) -> int:
    """Number of the newest manifest, 0 before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return 0
    found = [str(s.getPath().getName()) for s in fs.listStatus(path)]
    # a manifest counts once it is written as a whole
    return max([int(n[2:]) for n in found if n.startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest/{n}/_SUCCESS"))], default=0)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(day, path) of every day that is stored: one row per day."""
    version = _versions(spark, root)
    if not version:
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).json(f"{root}/manifest/v={version}")


def _publish(rows: DataFrame, root: str) -> None:
    spark = rows.sparkSession
    rows.select(F.col("day").cast("date").alias("day"), "path").coalesce(1).write.json(f"{root}/manifest/v={_versions(spark, root) + 1}")


def store_days(df: DataFrame, root: str, ts: str = "ts") -> None:
    """Write a table by day; its days replace those that are stored, other days stay as they are."""
    spark = df.sparkSession
    run = f"{root}/runs/{uuid.uuid4().hex}"
    by_day = df.withColumn(DAY, F.to_date(ts)).where(F.col(DAY).isNotNull())
    by_day.write.partitionBy(DAY).parquet(run)
    written = spark.read.schema(by_day.schema).parquet(run).select(F.col(DAY).cast("date").alias(DAY)).distinct()  # from the folder names
    new = written.withColumn("path", F.lit(run))
    _publish(manifest(spark, root).join(new, DAY, "left_anti").unionByName(new), root)


def load_days(spark: SparkSession, root: str, first=None, last=None) -> DataFrame | None:
    """The stored days, or those of a closed range, with their column `day`; None if there are none.

    Only the folders of these days are read.
    """
    days = manifest(spark, root)
    days = days if first is None else days.where(F.col(DAY) >= F.lit(first).cast("date"))
    days = days if last is None else days.where(F.col(DAY) <= F.lit(last).cast("date"))
    found = days.orderBy(DAY).collect()  # one row per day
    if not found:
        return None
    out = None
    for run in sorted({r["path"] for r in found}):
        own = spark.read.option("basePath", run).parquet(*[f"{run}/{DAY}={r['day']}" for r in found if r["path"] == run])
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def retain_days(spark: SparkSession, root: str, today, days: int) -> list[str]:
    """Drop days that are older than `days`, and the folders that only earlier manifests name; returns the days.

    Folders that no manifest has named yet belong to runs under way and stay.
    """
    before = manifest(spark, root)
    limit = F.date_sub(F.lit(today).cast("date"), days)
    gone = [str(r[DAY]) for r in before.where(F.col(DAY) < limit).orderBy(DAY).collect()]
    if gone:
        _publish(before.where(F.col(DAY) >= limit), root)
    if not _versions(spark, root):
        return gone
    named = spark.read.schema(_MANIFEST).json([f"{root}/manifest/v={v}" for v in range(1, _versions(spark, root) + 1)]).distinct()
    for r in named.join(manifest(spark, root), [DAY, "path"], "left_anti").collect():  # one row per replaced or dropped day
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{r['path']}/{DAY}={r[DAY]}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return gone
