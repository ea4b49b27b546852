"""Connected components as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerogrid.session import settle


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (v, comp): each vertex of the edges with the least vertex of its component.

    Every round takes the least label among the neighbours and then the label of that label, so long
    chains shrink by more than half; labels only fall, and the loop ends when none does.  Hubs are no
    hot groups: minima are taken map-side and the joins have one row per vertex on one side.
    """
    one = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    pairs = one.union(one.select("b", "a")).union(one.select("a", "a")).union(one.select("b", "b"))
    pairs = settle(pairs.distinct())
    labels = settle(pairs.groupBy("a").agg(F.min("b").alias("comp")).withColumnRenamed("a", "v"))
    while True:
        near = pairs.join(labels, pairs["b"] == labels["v"]).groupBy("a").agg(F.min("comp").alias("comp"))
        up = near.select(F.col("a").alias("_up"), F.col("comp").alias("_far"))
        moved = near.join(up, F.col("comp") == F.col("_up")).select(F.col("a").alias("v"), F.col("_far").alias("_new"))
        both = settle(moved.join(labels, "v").select("v", "comp", "_new"))
        labels = both.select("v", F.col("_new").alias("comp"))
        if both.where("_new < comp").isEmpty():
            return labels
