"""Regular time grid: resampling, grid construction, limited fills, forecast alignment, gap checks."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from aerogrid.functions.timefeat import ceil_time, epoch_us, floor_time, from_us
from aerogrid.operators.ordering import max_group_rows, over_series

# How each observation column is reduced inside one step.
RESAMPLE_RULES = {
    "wind_speed_kt": F.avg,
    "wind_direction": F.avg,
    "wind_gust_kt": F.max,
    "visibility_m": F.min,
    "ceiling_ft": F.min,
    "temperature_c": F.avg,
    "dewpoint_c": F.avg,
    "pressure_hpa": F.avg,
    "has_fog": F.max,
    "has_rain": F.max,
    "has_snow": F.max,
    "has_thunderstorm": F.max,
    "has_ice": F.max,
}


def resample(obs: DataFrame, minutes: int = 30) -> DataFrame:
    """One row per station and step.  All reducers combine map-side, so hot stations shuffle little."""
    rules = [f(c).alias(c) for c, f in RESAMPLE_RULES.items() if c in obs.columns]
    return obs.groupBy("station", floor_time("ts", minutes).alias("ts")).agg(*rules)


def station_bounds(obs: DataFrame, minutes: int = 30) -> DataFrame:
    """Stations with the common first and last grid step (one row per station)."""
    per_station = obs.groupBy("station").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    everything = Window.partitionBy(F.lit(0))  # one row per station at this point
    return per_station.select(
        "station",
        floor_time(F.min("lo").over(everything), minutes).alias("lo"),
        ceil_time(F.max("hi").over(everything), minutes).alias("hi"),
    )


def grid_span(obs: DataFrame, minutes: int = 30) -> tuple | None:
    """First and last step of the grid (two values to the driver), None without observations."""
    row = obs.agg(floor_time(F.min("ts"), minutes).alias("lo"), ceil_time(F.max("ts"), minutes).alias("hi")).first()
    return None if row["lo"] is None else (row["lo"], row["hi"])


def time_grid(obs: DataFrame, minutes: int = 30) -> DataFrame:
    """Every station at every step between the common bounds."""
    step = F.expr(f"INTERVAL {minutes} MINUTES")
    return by_station(station_bounds(obs, minutes)).select("station", F.explode(F.sequence("lo", "hi", step)).alias("ts"))


def by_station(df: DataFrame) -> DataFrame:
    """Rows dealt by station, as the grid's are: a few stations make many steps."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "station")


def join_steps(left: DataFrame, right: DataFrame, how: str, strategy: str = "blocked") -> DataFrame:
    """Join two tables of steps by station and time, sorted: plans take the size of exploded steps for that of their source and would broadcast them.

    With ``plain``, for series that a task can hold, the steps of `right` are sent to where the grid, dealt by station, has them, so that
    the grid, which has many more rows, is never shuffled.
    """
    if strategy == "plain":
        left.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # else both sides are dealt once more by both keys
        right = by_station(right)
    return left.join(right.hint("merge"), ["station", "ts"], how)


def series_strategy(obs: DataFrame, minutes: int = 30) -> str:
    """How windows over the grid's series are run: all series have the same length, which follows from the span, so none is counted."""
    return strategy_within(obs, grid_span(obs, minutes), minutes)


def strategy_within(df: DataFrame, span: tuple | None, minutes: int = 30) -> str:
    """The strategy for series of all steps within the span."""
    steps = 0 if span is None else (span[1] - span[0]) // timedelta(minutes=minutes) + 1
    return "plain" if steps <= max_group_rows(df) else "blocked"


def on_grid(obs: DataFrame, minutes: int = 30, fill_minutes: int | None = 60) -> DataFrame:
    """Grid rows with the resampled values, filled forward for at most `fill_minutes`."""
    strategy = series_strategy(obs, minutes)
    joined = join_steps(time_grid(obs, minutes), resample(obs, minutes), "left", strategy)
    return joined if fill_minutes is None else forward_fill(joined, fill_minutes // minutes, strategy=strategy)


def value_columns(df: DataFrame, keys: Sequence[str] = ("station", "ts")) -> list[str]:
    return [c for c in df.columns if c not in keys]


NEAR_ROWS = 4  # rows that are looked up one by one; a frame reads all of its rows anew at each row


def _known_before(w: WindowSpec, c: str, limit: int) -> Column:
    """The last known value of this and the `limit` rows before it."""
    if limit > NEAR_ROWS:
        return F.last(c, True).over(w.rowsBetween(-limit, 0))
    return F.coalesce(F.col(c), *[F.lag(c, i).over(w) for i in range(1, limit + 1)])


def _known_after(w: WindowSpec, c: str, limit: int) -> Column:
    """The first known value of this and the `limit` rows after it."""
    if limit > NEAR_ROWS:
        return F.first(c, True).over(w.rowsBetween(0, limit))
    return F.coalesce(F.col(c), *[F.lead(c, i).over(w) for i in range(1, limit + 1)])


def forward_fill(df: DataFrame, limit: int, columns: Sequence[str] | None = None, strategy: str = "auto") -> DataFrame:
    """Carry the last known value over at most `limit` following rows."""
    columns = list(columns) if columns is not None else value_columns(df)
    keep = [c for c in df.columns if c not in columns]
    return over_series(
        df,
        lambda w: [_known_before(w, c, limit).alias(c) for c in columns],
        tie="ts",
        back=limit,
        keep=keep,
        strategy=strategy,
    ).select(*df.columns)


def fill_both_ways(
    df: DataFrame, limit: int, columns: Sequence[str], ts: str = "ts", tie: str = "ts", strategy: str = "auto"
) -> DataFrame:
    """Forward fill up to `limit` rows, then backward fill up to `limit` rows, in one window pass.

    A row the forward pass leaves empty has only missing values in its `limit` predecessors, so the
    backward pass finds there exactly the first known original value of the next `limit` rows.
    """
    keep = [c for c in df.columns if c not in columns]
    return over_series(
        df,
        lambda w: [F.coalesce(_known_before(w, c, limit), _known_after(w, c, limit)).alias(c) for c in columns],
        ts=ts,
        tie=tie,
        back=limit,
        ahead=limit,
        keep=keep,
        strategy=strategy,
    ).select(*df.columns)


def forecast_on_grid(
    forecasts: DataFrame, columns: Sequence[str], minutes: int = 30, align: bool = False, within: tuple | None = None
) -> DataFrame:
    """Expand forecast periods to steps; the latest issue wins where periods overlap.

    Steps start at `valid_from`; without `align` a period that starts between grid steps meets no grid row.  `within` gives the first and
    last time of the grid, beyond which no steps are made, so a period with a stray end stays short.
    """
    start, end = floor_time("valid_from", minutes) if align else F.col("valid_from"), F.col("valid_to")
    step = F.expr(f"INTERVAL {minutes} MINUTES")
    if within is not None:
        width = minutes * 60_000_000
        late = F.greatest(F.ceil((epoch_us(F.lit(within[0])) - epoch_us(start)) / F.lit(width)), F.lit(0))  # whole steps, so the places stay
        start, end = from_us(epoch_us(start) + late * F.lit(width)), F.least(end, F.lit(within[1]))
    periods = forecasts.select("station", "issue_time", start.alias("_from"), end.alias("_to"), *columns)
    steps = periods.where(F.col("_to") >= F.col("_from")).select(
        "station", "issue_time", F.explode(F.sequence("_from", "_to", step)).alias("ts"), *columns
    )
    newest = F.max_by(F.struct(*columns), F.struct("issue_time", *columns))  # equal issues: the greater values
    return (
        steps.groupBy("station", "ts")
        .agg(newest.alias("f"))
        .select("station", "ts", *[F.col(f"f.{c}").alias(f"{c}_forecast") for c in columns])
    )


def time_gaps(df: DataFrame, limit_hours: float = 24, ingest: str = "event_id") -> DataFrame:
    """Per station: gaps longer than the limit, the longest gap, and backward jumps in arrival order."""
    us = epoch_us("ts")
    forward = over_series(
        df, lambda w: [(us - F.lag(us).over(w)).alias("_gap")], back=1, keep=["station", "ts", ingest]
    )
    in_order = over_series(
        df.select("station", "ts", ingest, from_us(F.col(ingest)).alias("_seq")),
        lambda w: [(us - F.lag(us).over(w)).alias("_jump")],
        ts="_seq",
        tie=ingest,
        back=1,
        keep=["station"],
        bucket_seconds=1,  # a million ids
    )
    gaps = forward.groupBy("station").agg(
        F.count_if(F.col("_gap") > F.lit(int(limit_hours * 3_600_000_000))).alias("large_gaps"),
        F.max("_gap").alias("longest_gap_us"),
    )
    jumps = in_order.groupBy("station").agg(F.count_if(F.col("_jump") < 0).alias("backward_jumps"))
    return gaps.join(jumps, "station")


def fill_gaps(df: DataFrame, columns: Sequence[str], minutes: int = 30, tie: str = "event_id") -> DataFrame:
    """Repeat a row over the gap to its successor: gap // step - 1 copies, each one step later."""
    us = epoch_us("ts")
    step = minutes * 60_000_000
    with_next = over_series(
        df, lambda w: [F.lead(us).over(w).alias("_next")], tie=tie, ahead=1, keep=["station", "ts", tie, *columns]
    )
    copies = F.when(
        F.col("_next") - us > F.lit(step), F.greatest(F.floor((F.col("_next") - us) / F.lit(step)) - 1, F.lit(0))
    ).otherwise(F.lit(0))
    steps = F.sequence(F.lit(0).cast("long"), copies.cast("long"))
    return (
        with_next.withColumn("copy", F.explode(steps))
        .withColumn("ts", from_us(us + F.col("copy") * F.lit(step)))
        .select("station", tie, "ts", "copy", *columns)
    )
