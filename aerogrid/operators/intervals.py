"""Labelling of points in time by the intervals that cover them.

No form here lists (point, interval) pairs, so overlapping intervals and hot stations stay linear:

* on a grid, intervals are turned into the steps they cover, combined per step, and equi-joined
* for points at any time, intervals become a step function per station (what holds from which moment
  on), and each point takes the value that holds at its moment
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerogrid.functions.num import flag
from aerogrid.functions.timefeat import ceil_time, epoch_us, floor_time
from aerogrid.operators.grid import join_steps, strategy_within
from aerogrid.operators.ordering import largest_group, max_group_rows, positions

SMALL_INTERVALS = 50_000  # intervals whose step function may be broadcast
SMALL_BUCKET = 256  # most interval ends in one station-hour for the broadcast form
BLOCK_LEVEL = 12  # values meet the positions in blocks of at most 2^12
BROADCAST_HOURS = 500_000  # station-hours of segments that may go to every task


@dataclass(frozen=True)
class Measure:
    """What to keep about the active intervals: `how` is max, min or sum of `value` (SQL text) over them."""

    name: str
    how: str
    value: str

    def merge(self, c: str | Column) -> Column:
        return {"max": F.max, "min": F.min, "sum": F.sum}[self.how](c)


ACTIVE = Measure("active", "max", "1")


# ---------------------------------------------------------------- grid labels


def grid_labels(
    grid: DataFrame, intervals: DataFrame, minutes: int, measures: Sequence[Measure], bounds: str = "closed", within: tuple | None = None
) -> DataFrame:
    """Label grid steps.  bounds: closed [start,end], half_open [start,end), overlap (starts inside or active).

    `within` gives the first and last time of the grid, which is made once more to find them otherwise.
    """
    step = F.expr(f"INTERVAL {minutes} MINUTES")
    micro = F.expr("INTERVAL 1 MICROSECOND")
    start, end = F.col("start_time"), F.col("end_time")
    if bounds == "closed":
        lo, hi = ceil_time(start, minutes), floor_time(end, minutes)
    elif bounds == "half_open":
        lo, hi = ceil_time(start, minutes), floor_time(end - micro, minutes)
    elif bounds == "overlap":
        lo = floor_time(start, minutes)
        hi = F.greatest(lo, floor_time(end - micro, minutes))
    else:
        raise ValueError(f"unknown bounds {bounds}")
    first, last = within or grid.agg(F.min("ts"), F.max("ts")).first()  # steps outside the grid label nothing
    lo, hi = F.greatest(lo, F.lit(first)), F.least(hi, F.lit(last))
    covered = intervals.select("station", lo.alias("_lo"), hi.alias("_hi"), *[F.expr(m.value).alias(m.name) for m in measures])
    steps = (
        covered.where(F.col("_lo") <= F.col("_hi"))
        .withColumn("ts", F.explode(F.sequence("_lo", "_hi", step)))
        .groupBy("station", "ts")
        .agg(*[m.merge(m.name).alias(m.name) for m in measures])
    )
    return join_steps(grid, steps, "left", strategy_within(grid, None if first is None else (first, last), minutes))


# ---------------------------------------------------------------- step functions


def _dyadic_nodes(lo: Column, hi: Column, levels: int) -> Column:
    """Cover of the positions [lo, hi) by aligned blocks of length 2^level, at most two per level."""

    def at(level: Column) -> Column:
        size = F.pow(F.lit(2.0), level).cast("long")
        left = F.ceil(lo / size).cast("long")
        right = F.floor(hi / size).cast("long")
        return F.array_compact(
            F.array(
                F.when((left < right) & (left % 2 == 1), F.struct(level.alias("level"), left.alias("node"))),
                F.when(
                    (left < right) & (right % 2 == 1) & ((right - 1 != left) | (left % 2 == 0)),
                    F.struct(level.alias("level"), (right - 1).alias("node")),
                ),
            )
        )

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at))


def step_function(
    intervals: DataFrame, measures: Sequence[Measure], closed: bool = False, size: tuple[int, int] | None = None
) -> DataFrame:
    """(station, from_us, to_us, measures): the combined value of the intervals active in each segment.

    Every interval is split over at most 2·log2(n) aligned blocks of boundary positions, values are
    combined per block, and each segment combines the blocks it lies in.  Blocks longer than 2^BLOCK_LEVEL are few once
    combined, and are cut into blocks of that length, so that the positions of a hot station never meet under one
    key.  Segments without an active interval have null measures.
    """
    number, _ = size or _interval_size(intervals)
    levels = max(1, math.ceil(math.log2(2 * number + 2)))
    low = min(levels, BLOCK_LEVEL)
    names = [m.name for m in measures]
    micro = F.expr("INTERVAL 1 MICROSECOND")
    end = F.col("end_time") + micro if closed else F.col("end_time")
    raw = intervals.select(
        "station", F.col("start_time").alias("_s"), end.alias("_e"), *[F.expr(m.value).alias(m.name) for m in measures]
    ).where(F.col("_s") < F.col("_e"))
    merged = [m.merge(m.name).alias(m.name) for m in measures]
    spans = raw.groupBy("station", "_s", "_e").agg(*merged)
    if number <= SMALL_INTERVALS:
        placed, ranged = _place_small(spans, names)
    else:
        placed, ranged = _place_large(spans)
    nodes = (
        ranged.select("station", F.explode(_dyadic_nodes(F.col("_lo"), F.col("_hi"), levels)).alias("_n"), *names)
        .groupBy("station", F.col("_n.level").alias("level"), F.col("_n.node").alias("node"))
        .agg(*merged)
    )
    if levels > low:
        size_up = F.pow(F.lit(2.0), F.col("level") - low).cast("long")
        cut = nodes.where(F.col("level") > low).withColumn("node", F.explode(F.sequence(F.col("node") * size_up, (F.col("node") + 1) * size_up - 1)))
        both = nodes.where(F.col("level") <= low).unionByName(cut.withColumn("level", F.lit(low)))
        nodes = both.groupBy("station", "level", "node").agg(*merged)
    lookups = placed.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(low)))).withColumn(
        "node", F.expr("shiftright(_pos, level)")
    )
    return (
        lookups.join(nodes, ["station", "level", "node"], "left")
        .groupBy("station", "_pos", "from_us", "to_us")
        .agg(*merged)
        .drop("_pos")
    )


def _place_small(spans: DataFrame, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Boundary positions of a checked-small table: one sort per station, reused by what follows."""
    by_time = Window.partitionBy("station").orderBy("_t")
    ends = spans.withColumn("_t", F.explode(F.array("_s", "_e")))
    ranked = ends.select(
        "*",
        (F.dense_rank().over(by_time) - 1).cast("long").alias("_pos"),
        epoch_us("_t").alias("from_us"),
    )
    placed = ranked.groupBy("station", "_pos").agg(F.max("from_us").alias("from_us"))
    nxt = F.lead("from_us").over(Window.partitionBy("station").orderBy("_pos"))
    placed = placed.withColumn("to_us", nxt)
    ranged = ranked.groupBy("station", "_s", "_e").agg(
        F.min("_pos").alias("_lo"), F.max("_pos").alias("_hi"), *[F.first(n).alias(n) for n in names]
    )
    return placed, ranged


def _place_large(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boundary positions without a task per station."""
    points = spans.select("station", F.explode(F.array("_s", "_e")).alias("t")).distinct()
    ranked = positions(points, ["station"], "t", "t", bucket_seconds=30 * 86_400)
    ends = ranked.select("station", "t", F.col("_pos").alias("_p"))
    ranged = spans.join(
        ends.select("station", F.col("t").alias("_s"), F.col("_p").alias("_lo")), ["station", "_s"]
    ).join(ends.select("station", F.col("t").alias("_e"), F.col("_p").alias("_hi")), ["station", "_e"])
    nxt = ranked.select("station", (F.col("_pos") - 1).alias("_pos"), epoch_us("t").alias("to_us"))
    placed = ranked.select("station", "_pos", epoch_us("t").alias("from_us")).join(nxt, ["station", "_pos"], "left")
    return placed, ranged


def _interval_size(intervals: DataFrame) -> tuple[int, int]:
    """Number of intervals, and the most that start or end in one station-hour (two numbers to the driver)."""
    hours = intervals.select(
        "station", F.explode(F.array(floor_time("start_time", 60), floor_time("end_time", 60))).alias("_h")
    )
    row = (
        hours.groupBy("station", "_h")
        .agg(F.count(F.lit(1)).alias("_c"))
        .agg(F.coalesce(F.sum("_c"), F.lit(0)), F.coalesce(F.max("_c"), F.lit(0)))
        .first()
    )
    return (int(row[0]) + 1) // 2, int(row[1])


def label_points(
    points: DataFrame,
    intervals: DataFrame,
    measures: Sequence[Measure] = (ACTIVE,),
    closed: bool = False,
    ts: str = "ts",
    strategy: str = "auto",
) -> DataFrame:
    """Add the measures of the intervals active at each point (null where none is).

    broadcast: the checked-small step function goes to every task and the points are not shuffled; one of more than
               BROADCAST_HOURS rows is never sent, and its points are labelled in the sorted way, with the same rows.
    sorted:    points and segments meet in (station, hour) buckets and each point takes the last
               segment at or before it; over-full buckets are salted.
    """
    size = _interval_size(intervals)
    if strategy == "auto":
        strategy = "broadcast" if size[0] <= SMALL_INTERVALS and size[1] <= SMALL_BUCKET else "sorted"
    names = [m.name for m in measures]
    hour = 3_600_000_000
    segments = step_function(intervals, measures, closed, size).where(F.col("to_us").isNotNull())
    known = None
    for n in names:
        known = F.col(n).isNotNull() if known is None else known | F.col(n).isNotNull()
    spread = segments.where(known).withColumn(
        "_b", F.explode(F.sequence(F.floor(F.col("from_us") / hour), F.floor((F.col("to_us") - 1) / hour)))
    )
    if strategy == "broadcast":  # long segments stand in every hour they cover
        hours = F.floor((F.col("to_us") - 1) / hour) - F.floor(F.col("from_us") / hour) + 1
        if (segments.where(known).agg(F.sum(hours)).first()[0] or 0) > BROADCAST_HOURS:
            strategy = "sorted"
    tagged = points.withColumn("_us", epoch_us(ts)).withColumn("_b", F.floor(F.col("_us") / hour))
    if strategy == "broadcast":
        right = F.broadcast(spread.withColumnsRenamed({"station": "_st", "_b": "_rb"}))
        cond = (
            (F.col("station") == F.col("_st"))
            & (F.col("_b") == F.col("_rb"))
            & (F.col("_us") >= F.col("from_us"))
            & (F.col("_us") < F.col("to_us"))
        )
        return tagged.join(right, cond, "left").drop("_us", "_b", "_st", "_rb", "from_us", "to_us")
    salts = max(1, math.ceil(largest_group(tagged, ["station", "_b"]) / max_group_rows(points)))
    state = spread.select(
        "station",
        "_b",
        F.greatest(F.col("from_us"), F.col("_b") * hour).alias("_us"),
        F.lit(0).alias("_kind"),
        F.struct("to_us", *names).alias("_state"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"),
    )
    salted = tagged.withColumn("_kind", F.lit(1)).withColumn(
        "_salt", F.pmod(F.xxhash64(*points.columns), F.lit(salts)).cast("int")
    )
    w = (
        Window.partitionBy("station", "_b", "_salt")
        .orderBy("_us", "_kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    both = salted.unionByName(state, allowMissingColumns=True)
    held = both.withColumn("_held", F.last("_state", True).over(w)).where(F.col("_kind") == 1)
    holds = F.col("_us") < F.col("_held.to_us")
    return held.select(*points.columns, *[F.when(holds, F.col(f"_held.{n}")).alias(n) for n in names])


# ---------------------------------------------------------------- windows around intervals


def sampling_windows(intervals: DataFrame, before_hours: int = 6, after_hours: int = 2) -> DataFrame:
    """Windows from `before_hours` before an interval to `after_hours` after it."""
    return intervals.select(
        "station",
        (F.col("start_time") - F.expr(f"INTERVAL {before_hours} HOURS")).alias("window_start"),
        (F.col("end_time") + F.expr(f"INTERVAL {after_hours} HOURS")).alias("window_end"),
        "start_time",
        "end_time",
        "reason",
        (F.col("duration_min").cast("double") / F.lit(60.0)).alias("duration_hours"),
        "ordinal",
    )


def label_with_windows(points: DataFrame, windows: DataFrame, strategy: str = "auto") -> DataFrame:
    """Add has_regulation, in_window and time_to_regulation.

    Where windows overlap, the last one in file order gives the hours to its interval start.
    """
    spans = windows.selectExpr(
        "station",
        "ordinal",
        "start_time AS _start",
        """explode(array(named_struct('inner', 1, 'start_time', start_time, 'end_time', end_time),
                         named_struct('inner', 0, 'start_time', window_start, 'end_time', window_end))) AS _s""",
    ).select("station", "ordinal", epoch_us("_start").alias("start_us"), "_s.*")
    measures = [
        Measure("_now", "max", "CASE WHEN inner = 1 THEN 1 END"),
        Measure("_win", "max", "CASE WHEN inner = 0 THEN struct(ordinal, start_us) END"),
    ]
    outer = label_points(points, spans, measures, strategy=strategy)
    hours = (F.col("_win.start_us") - epoch_us("ts")).cast("double") / F.lit(3_600_000_000.0)
    return outer.select(
        *points.columns,
        flag(F.col("_now") == 1).alias("has_regulation"),
        flag(F.col("_win").isNotNull()).alias("in_window"),
        hours.alias("time_to_regulation"),
    )


def imminence(df: DataFrame, fill: float | None = None) -> DataFrame:
    """hours_to_regulation and the flag for 0..2 hours.

    `fill` replaces missing hours; by default they must have been filled before (by the median), which
    is what the sampling flow does.  The value looks ahead in time, so keep it out of training columns.
    """
    hours = F.col("time_to_regulation")
    if fill is not None:
        hours = F.coalesce(hours, F.lit(float(fill)))
    return df.withColumn("hours_to_regulation", hours).withColumn(
        "regulation_imminent", flag((hours >= 0) & (hours <= 2))
    )
