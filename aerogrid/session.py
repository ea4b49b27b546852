"""Session helpers for tests, the benchmark and the command line."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEALT_ROWS = 1_000_000  # for few passes fewer are not worth a shuffle


def local_session(cpus: int | str = 8, app: str = "aerogrid", memory: str = "8g") -> SparkSession:
    """A local session with the settings every query here assumes (UTC, AQE, few shuffle partitions)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only for a local master that names none."""
    current = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        current = tempfile.mkdtemp(prefix="aerogrid-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the checkpoint folder, which every executor can reach."""
    return f"{checkpoint_dir(spark).rstrip('/')}/scratch/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write a frame that several jobs read to the checkpoint folder and go on from there.

    The copy survives the loss of executors, and the plan behind it runs once.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def settle_by_column(df: DataFrame, name: str = "settled") -> DataFrame:
    """`settle` for long tables: Parquet keeps few bytes of a grid whose rows are much alike, a checkpoint all of them."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def part_sizes(df: DataFrame) -> list[int]:
    """Rows of each partition that has any."""
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]  # one number per partition


def uneven(sizes: Sequence[int], cores: int) -> bool:
    """Whether some partition holds over twice its share: a file is read in few and uneven parts."""
    return max(sizes, default=0) * cores > 2 * sum(sizes)


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over the cores, if there are many in uneven partitions; they are counted, so `df` should be quick to read."""
    n, sizes = df.sparkSession.sparkContext.defaultParallelism, part_sizes(df)
    return df.repartition(n) if sum(sizes) >= DEALT_ROWS and uneven(sizes, n) else df
