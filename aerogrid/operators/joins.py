"""Equi, semi and positional joins, unions, and rates per condition."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerogrid.functions.num import rnd
from aerogrid.operators.ordering import positions


BROADCAST_BYTES = 8 << 20  # counted bytes of a table that may go to every task


def broadcast_if_small(table: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`table`, cheap to read, with a broadcast hint if its rows take at most `limit` bytes; else a shuffled join, whose hot keys are split at run time."""
    text = sum((F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) for c, kind in table.dtypes if kind in ("string", "binary")), F.lit(0))
    size = table.agg(F.sum(text + F.lit(48 + 8 * len(table.columns)))).first()[0] or 0
    return F.broadcast(table) if size <= limit else table


def at_times(df: DataFrame, times: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys occur in a label table (left semi join, no duplicates however often they occur)."""
    return df.join(times, list(keys), "left_semi")


def select_stations(
    intervals: DataFrame, obs: DataFrame, more_than: int = 20, top: int = 5, default: str | None = None
) -> DataFrame:
    """Stations with observations and enough active intervals, most first; a default if there is none."""
    counts = intervals.groupBy("station").agg(F.count(F.lit(1)).alias("active_intervals"))
    known = obs.select("station").distinct()
    ranked = (
        counts.where(F.col("active_intervals") > more_than)
        .join(known, "station", "left_semi")
        .orderBy(F.desc("active_intervals"), "station")
        .limit(top)
    )
    if default is None:
        return ranked
    fallback = counts.sparkSession.createDataFrame([(default, 0)], "station string, active_intervals long")
    found = ranked.agg(F.count(F.lit(1)).alias("_n"))
    spare = fallback.join(F.broadcast(found), F.col("_n") == 0).drop("_n")  # one row on each side
    return ranked.unionByName(spare)


def side_by_side(blocks: Sequence[DataFrame], ts: str, tie: str) -> DataFrame:
    """Put column blocks of the same rows next to each other by row number per station."""
    numbered = [positions(b, ["station"], ts, tie, out="row_no").drop(ts, tie) for b in blocks]
    return reduce(lambda a, b: a.join(b, ["station", "row_no"]), numbered)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of frames by column name; columns a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def rates_by_condition(df: DataFrame, conditions: Sequence[str], label: str) -> DataFrame:
    """Positive rate where each 0/1 condition holds and where it does not, in one aggregation."""
    long = df.select(
        label, F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), F.col(c).alias("present")) for c in conditions])).alias("_e")
    )
    return long.groupBy("_e.condition", "_e.present").agg(
        F.count(F.lit(1)).alias("n"), F.sum(label).alias("positives"), rnd(F.avg(label)).alias("positive_rate")
    )


def positive_times(labels: DataFrame) -> DataFrame:
    """(ts, stations, n_stations) of labelled (station, ts): the stations of each time, in order and comma-joined."""
    once = labels.select("station", "ts").distinct()
    return once.groupBy("ts").agg(F.array_join(F.array_sort(F.collect_list("station")), ",").alias("stations"), F.count(F.lit(1)).alias("n_stations"))


def wide_times(labels: DataFrame, stations: Sequence[str]) -> DataFrame:
    """One row per time with a 0/1 column for each of the given stations; for few, as each is a column."""
    hits = [F.max((F.col("station") == s).cast("int")).alias(s) for s in stations]
    return labels.groupBy("ts").agg(*hits)
