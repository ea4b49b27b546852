"""Ordered work that does not depend on how rows are spread over groups.

A series may hold a third of all rows, so `Window.partitionBy(series)` alone would put that third
into one task.  Three building blocks avoid it:

* `positions`       dense 0-based row positions per series, from per-time-bucket ranks plus offsets
* `over_series`     windows with bounded row frames, run per block of positions with halo rows
* `running_totals`  exact cumulative sums over the ordered distinct values of a column
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from aerogrid.functions.num import col
from aerogrid.functions.timefeat import epoch_us

MAX_GROUP_ROWS = "spark.aerogrid.maxGroupRows"  # rows of one group that a single task may sort
BLOCK_ROWS = "spark.aerogrid.blockRows"  # rows per block of the blocked windows
RANGE_ROWS = "spark.aerogrid.rangeRows"  # rows of a value range that a single task may sort


def _limit(df: DataFrame, key: str, default: int) -> int:
    return int(df.sparkSession.conf.get(key, str(default)))


def max_group_rows(df: DataFrame) -> int:
    return _limit(df, MAX_GROUP_ROWS, 2_000_000)


def largest_group(df: DataFrame, keys: Sequence[str | Column]) -> int:
    """Rows of the largest group: one column-pruned aggregation, one number to the driver."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    return int(counts.agg(F.coalesce(F.max("_c"), F.lit(0))).first()[0])


def time_bucket(ts: str | Column, seconds: int) -> Column:
    """Number of the fixed-width time bucket a timestamp lies in."""
    return F.floor(epoch_us(ts) / F.lit(seconds * 1_000_000)).cast("long")


def grouped(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal keys, from Arrow batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        key = list(zip(*[batch[k].to_pylist() for k in keys], strict=True))
        starts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)] if key else []
        for i, j in zip(starts, starts[1:], strict=False):
            if held and key[i] != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held_key = key[i]
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def positions(
    df: DataFrame,
    group: Sequence[str],
    ts: str,
    tie: str,
    out: str = "_pos",
    bucket_seconds: int = 86_400,
) -> DataFrame:
    """Add the dense 0-based position of each row in its group, ordered by (ts, tie).

    Ranks are taken per (group, time bucket) and shifted by the rows of the earlier buckets, so no
    task sees a whole group.  If even one time bucket is too large (copies with one timestamp), the
    bucket is cut further by (ts, high bits of tie); `tie` must be a whole number or a time then.
    """
    group = list(group)
    limit = max_group_rows(df)
    bucket = time_bucket(ts, bucket_seconds).alias("_b")
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tagged = df.withColumn("_b", bucket)
    counts = tagged.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_c"))
    offsets = counts.select(*group, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    if largest_group(tagged, [*group, "_b"]) <= limit:
        ranked = _keyed(tagged, [*group, "_b"]).withColumn(
            "_rn", F.row_number().over(Window.partitionBy("_key").orderBy(ts, tie)).cast("long")
        )
        joined = _join_small_key(ranked, offsets, [*group, "_b"])
        return joined.withColumn(out, F.col("_rn") - 1 + F.col("_off")).drop("_b", "_rn", "_off")
    shift = max(0, limit.bit_length() - 1)
    is_time = dict(df.dtypes)[tie].startswith("timestamp")
    number = epoch_us(tie) if is_time else F.col(tie).cast("long")
    fine = tagged.withColumn("_t", epoch_us(ts)).withColumn("_h", F.shiftright(number, shift))
    cells = fine.groupBy(*group, "_b", "_t", "_h").agg(F.count(F.lit(1)).alias("_c"))
    inner = Window.partitionBy(*group, "_b").orderBy("_t", "_h").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*group, "_b", "_t", "_h", F.coalesce(F.sum("_c").over(inner), F.lit(0)).alias("_off2"))
    cells = _join_small_key(_keyed(cells, [*group, "_b"]), offsets, [*group, "_b"])
    ranked = _keyed(fine, [*group, "_b", "_t", "_h"]).withColumn(
        "_rn", F.row_number().over(Window.partitionBy("_key").orderBy(tie)).cast("long")
    )
    joined = _join_small_key(ranked, cells, [*group, "_b", "_t", "_h"])
    pos = F.col("_rn") - 1 + F.col("_off") + F.col("_off2")
    return joined.withColumn(out, pos).drop("_b", "_t", "_h", "_rn", "_off", "_off2")


def _keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add `_key`, a struct of the keys: never null itself, and null fields compare equal.

    Windows partition by it and joins match on it, so a join after a window needs no further shuffle
    of the rows and keeps the rows whose keys are missing.
    """
    return df.withColumn("_key", F.struct(*keys))


def _join_small_key(rows: DataFrame, keyed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join per-key values back to rows that carry `_key` already."""
    return rows.join(_keyed(keyed, keys).drop(*keys), "_key").drop("_key")


def over_series(
    df: DataFrame,
    build: Callable[[WindowSpec], Sequence[Column]],
    group: Sequence[str] = ("station",),
    ts: str = "ts",
    tie: str = "event_id",
    back: int = 0,
    ahead: int = 0,
    keep: Sequence[str] | None = None,
    strategy: str = "auto",
    sizes: DataFrame | None = None,
    bucket_seconds: int = 86_400,
) -> DataFrame:
    """Add window columns whose frames reach at most `back` rows back and `ahead` rows ahead.

    `build` gets the ordered window spec and returns the new columns.  With ``auto`` the plain window
    is used while the largest series fits one task; beyond that rows are cut into blocks of positions,
    each with a halo copied from its neighbours, so the largest task has a fixed number of rows.
    `sizes` is a frame with the same rows per series that is cheaper to count than `df`.
    """
    group = list(group)
    kept = list(keep) if keep is not None else df.columns
    if strategy == "auto":
        counted = df if sizes is None else sizes
        strategy = "plain" if largest_group(counted, group) <= max_group_rows(df) else "blocked"
    if strategy == "plain":
        return df.select(*kept, *build(Window.partitionBy(*group).orderBy(ts, tie)))
    size = max(_limit(df, BLOCK_ROWS, 500_000), back + ahead, 1)
    placed = positions(df, group, ts, tie, bucket_seconds=bucket_seconds)
    own = F.floor(F.col("_pos") / F.lit(size)).cast("long")
    rest = F.col("_pos") % F.lit(size)
    copies = F.array_compact(
        F.array(
            own,
            F.when(rest >= F.lit(size - back), own + 1),
            F.when((rest < F.lit(ahead)) & (own > 0), own - 1),
        )
    )
    spread = placed.withColumn("_block", F.explode(copies))
    w = Window.partitionBy(*group, "_block").orderBy("_pos")
    out = spread.select(*kept, "_pos", "_block", *build(w))
    return out.where(F.col("_block") == F.floor(F.col("_pos") / F.lit(size))).drop("_pos", "_block")


def _up_to_here(w: WindowSpec) -> WindowSpec:
    """Growing frame: Spark carries it forward row by row, while a frame to the end of the group is
    evaluated anew for every row.  Looking ahead is therefore a growing frame in descending order."""
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def fill_series(
    df: DataFrame,
    columns: Sequence[str],
    group: Sequence[str] = ("station",),
    ts: str = "ts",
    tie: str = "event_id",
    strategy: str = "auto",
    backward: bool = True,
) -> DataFrame:
    """Unlimited forward fill, then (unless switched off) backward fill, of `columns` per series.

    Blocked form: fill inside each block, then carry the last (first) known value of the earlier
    (later) blocks over the per-block summary, which has one row per block.
    """
    group = list(group)
    others = [c for c in df.columns if c not in columns]
    if strategy == "auto":
        strategy = "plain" if largest_group(df, group) <= max_group_rows(df) else "blocked"
    if strategy == "plain":
        known = _up_to_here(Window.partitionBy(*group).orderBy(ts, tie))
        coming = _up_to_here(Window.partitionBy(*group).orderBy(F.desc(ts), F.desc(tie)))
        return df.select(
            *others,
            *[
                F.coalesce(F.last(c, True).over(known), *([F.last(c, True).over(coming)] if backward else [])).alias(c)
                for c in columns
            ],
        ).select(*df.columns)
    size = max(_limit(df, BLOCK_ROWS, 500_000), 1)
    placed = positions(df, group, ts, tie).withColumn("_block", F.floor(F.col("_pos") / F.lit(size)).cast("long"))
    ends = [
        f(F.when(F.col(c).isNotNull(), F.struct(F.col("_pos"), F.col(c)))).alias(f"{p}{c}")
        for c in columns
        for p, f in (("_l_", F.max), ("_f_", F.min))
    ]
    blocks = placed.groupBy(*group, "_block").agg(*ends)
    prev = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    nxt = Window.partitionBy(*group).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        *group,
        "_block",
        *[F.last(F.col(f"_l_{c}")[c], True).over(prev).alias(f"_p_{c}") for c in columns],
        *[F.last(F.col(f"_f_{c}")[c], True).over(nxt).alias(f"_n_{c}") for c in columns],
    )
    placed = _keyed(placed, [*group, "_block"])
    known = _up_to_here(Window.partitionBy("_key").orderBy("_pos"))
    coming = _up_to_here(Window.partitionBy("_key").orderBy(F.desc("_pos")))
    inner = placed.select(
        *others,
        "_key",
        *[F.last(c, True).over(known).alias(f"_i_{c}") for c in columns],
        *[F.last(c, True).over(coming).alias(f"_j_{c}") for c in columns],
    )
    joined = _join_small_key(inner, blocks, [*group, "_block"])
    sources = ["_i_", "_p_", "_j_", "_n_"] if backward else ["_i_", "_p_"]
    filled = [F.coalesce(*[F.col(f"{s}{c}") for s in sources]).alias(c) for c in columns]
    return joined.select(*others, *filled).select(*df.columns)


def range_count(df: DataFrame, least: int = 2) -> int:
    """How many value ranges to cut a table into: as many as shuffle partitions, and more if a range had over `rangeRows` rows.

    A table whose planned size is far below that is not counted.
    """
    spark = df.sparkSession
    parts = max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    rows = _limit(df, RANGE_ROWS, 1_000_000)
    planned = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return parts if planned < parts * rows else max(parts, -(-df.count() // rows))  # at least a byte a row, however packed


def value_splits(df: DataFrame, columns: Sequence[str], parts: int | None = None) -> dict[str, list[float]]:
    """Cut points that spread the values of numeric columns evenly (one pass, mergeable sketches)."""
    columns = list(columns)
    parts = parts or range_count(df.select(*columns))
    probs = [i / parts for i in range(1, parts)]
    numbers = df.select(*[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(columns)])
    cuts = numbers.approxQuantile(numbers.columns, probs, min(0.01, 0.25 / parts))
    return {c: sorted({float(x) for x in found if x is not None}) for c, found in zip(columns, cuts)}


def with_ranges(df: DataFrame, columns: Sequence[str], parts: int | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Add the value range of each column, and return the names of the added columns."""
    columns = list(columns)
    splits = value_splits(df, columns, parts)
    added = {c: f"_range{i}" for i, c in enumerate(columns)}
    made = Bucketizer(
        splitsArray=[_all_splits(splits[c]) for c in columns],
        inputCols=[f"_in{i}" for i in range(len(columns))],
        outputCols=[added[c] for c in columns],
        handleInvalid="keep",
    ).transform(df.withColumns({f"_in{i}": F.col(c).cast("double") for i, c in enumerate(columns)}))
    return made.drop(*[f"_in{i}" for i in range(len(columns))]), added


def _all_splits(cuts: list[float]) -> list[float]:
    return [float("-inf"), *(cuts or [0.0]), float("inf")]


def accumulate(
    cells: DataFrame,
    group: Sequence[str],
    value: str,
    measures: Sequence[str],
    descending: bool = False,
    how: str = "sum",
    strict: bool = False,
) -> DataFrame:
    """Running sums (or maxima) over rows that are unique per (group, value) and carry the value range `_r`.

    Results inside a range are combined with those of the earlier ranges of the group, so no task sees a
    whole group.  `strict` leaves the row itself out.  Adds `<m>_cum` and `<m>_total`.
    """
    group, measures = list(group), list(measures)
    fold = {"sum": F.sum, "max": F.max}[how]
    order = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    ranges = cells.groupBy(*group, "_r").agg(*[fold(m).alias(f"_s_{m}") for m in measures])
    over = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = over.orderBy(order("_r")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        *group,
        "_r",
        *[fold(f"_s_{m}").over(before).alias(f"_o_{m}") for m in measures],
        *[fold(f"_s_{m}").over(over).alias(f"{m}_total") for m in measures],
    )
    inner = (
        Window.partitionBy("_key").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    )
    local = _keyed(cells, [*group, "_r"]).select("*", *[fold(m).over(inner).alias(f"_c_{m}") for m in measures])
    joined = _join_small_key(local, ranges, [*group, "_r"])

    def combined(m: str) -> Column:
        here, earlier = F.col(f"_c_{m}"), F.col(f"_o_{m}")
        if how == "max":
            return F.greatest(here, earlier)
        return F.coalesce(here, F.lit(0)) + F.coalesce(earlier, F.lit(0))

    return joined.select(
        *group,
        value,
        *measures,
        *[combined(m).alias(f"{m}_cum") for m in measures],
        *[f"{m}_total" for m in measures],
    )


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    sums: Sequence[str],
    parts: int | None = None,
    descending: bool = False,
) -> DataFrame:
    """Exact running sums of `sums` over the ordered distinct values of `value`, per group.

    One row per (group, value) with `<s>` (at this value), `<s>_cum` (up to and including it) and
    `<s>_total`.  Ties are summed map-side first, so a value that a third of the rows share is one cell.
    """
    ranged, names = with_ranges(df.where(F.col(value).isNotNull()), [value], parts)
    cells = ranged.groupBy(*group, F.col(names[value]).alias("_r"), value).agg(*[F.sum(s).alias(s) for s in sums])
    return accumulate(cells, group, value, sums, descending)


def long_cells(
    df: DataFrame, columns: Sequence[str], group: Sequence[str], sums: dict[str, Column], parts: int | None = None
) -> DataFrame:
    """Distinct values of several columns as rows (group, feature, _r, value) with summed measures."""
    ranged, names = with_ranges(df, columns, parts)
    kept = [*group, *[e.alias(n) for n, e in sums.items()]]
    entries = []
    for i, c in enumerate(columns):
        known = F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
        entry = F.struct(F.col(names[c]).alias("_r"), (F.col(c).cast("double") + F.lit(0.0)).alias("value"))
        entries.append(F.when(known, entry).alias(f"_e{i}"))
    ids = [*group, *sums]
    long = ranged.select(*kept, *entries).unpivot(ids, [f"_e{i}" for i in range(len(columns))], "_name", "_e")
    cells = (
        long.where(F.col("_e").isNotNull())
        .groupBy(*group, "_name", F.col("_e._r").alias("_r"), F.col("_e.value").alias("value"))
        .agg(*[F.sum(n).alias(n) for n in sums])
    )
    named = F.element_at(F.array(*[F.lit(c) for c in columns]), F.substring("_name", 3, 9).cast("int") + 1)
    return cells.withColumn("feature", named).drop("_name")


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], group: Sequence[str] = (), parts: int | None = None
) -> DataFrame:
    """Exact, linearly interpolated quantiles: one row per (group, feature), `q0..`, plus the count `n`.

    Without groups, exact counts per value range tell which ranges hold the wanted ranks, and only the
    rows of those ranges are shuffled and ordered.  With groups, running counts cover all ranges.
    """
    if not group:
        return _quantiles_by_range(df, list(columns), list(probs), parts)
    group = list(group)
    cells = long_cells(df, columns, group, {"n": F.lit(1).cast("long")}, parts)
    cum = accumulate(cells, [*group, "feature"], "value", ["n"])
    aggs = []
    for i, p in enumerate(probs):
        rank = (F.col("n_total") - 1) * F.lit(float(p))
        aggs.append(F.min(F.when(F.col("n_cum") > F.floor(rank), F.col("value"))).alias(f"_lo{i}"))
        aggs.append(F.min(F.when(F.col("n_cum") > F.ceil(rank), F.col("value"))).alias(f"_hi{i}"))
    found = cum.groupBy(*group, "feature").agg(F.max("n_total").alias("n"), *aggs)
    frac = [(F.col("n") - 1) * F.lit(float(p)) - F.floor((F.col("n") - 1) * F.lit(float(p))) for p in probs]
    return found.select(
        *group,
        "feature",
        "n",
        *[
            (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * frac[i]).alias(f"q{i}")
            for i in range(len(probs))
        ],
    )


def _long_ranges(ranged: DataFrame, names: dict[str, str], wanted: dict[str, set[float]] | None = None) -> DataFrame:
    """(feature number, range, value) rows of several columns, optionally only of the wanted ranges."""
    entries = []
    for i, (c, r) in enumerate(names.items()):
        known = F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
        if wanted is not None:
            known = known & F.col(r).isin([float(x) for x in wanted[c]])
        entry = F.struct(F.col(r).alias("_r"), (F.col(c).cast("double") + F.lit(0.0)).alias("value"))
        entries.append(F.when(known, entry).alias(str(i)))
    long = ranged.select(*entries).unpivot([], [str(i) for i in range(len(names))], "feature", "_e")
    return long.where(F.col("_e").isNotNull()).select(F.col("feature").cast("int").alias("feature"), "_e.*")


def _quantiles_by_range(df: DataFrame, columns: list[str], probs: list[float], parts: int | None) -> DataFrame:
    spark = df.sparkSession
    if parts is None:
        parts = range_count(df.select(*columns), 64)
    ranged, names = with_ranges(df.select(*columns), columns, parts)
    counts: dict[str, dict[float, int]] = {c: {} for c in columns}
    for row in _long_ranges(ranged, names).groupBy("feature", "_r").count().collect():  # columns x ranges numbers
        counts[columns[row["feature"]]][row["_r"]] = row["count"]
    targets, wanted = [], {c: set() for c in columns}
    for i, c in enumerate(columns):
        n = sum(counts[c].values())
        for j, p in enumerate(probs if n else []):
            for side, rank in enumerate((math.floor((n - 1) * p), math.ceil((n - 1) * p))):
                before = 0
                for r in sorted(counts[c]):
                    if rank < before + counts[c][r]:
                        targets.append((i, r, j, side, rank - before))
                        wanted[c].add(r)
                        break
                    before += counts[c][r]
    found: dict[tuple[int, int, int], float] = {}
    if targets:
        cells = _long_ranges(ranged, names, wanted).groupBy("feature", "_r", "value").agg(F.count(F.lit(1)).alias("n"))
        inner = Window.partitionBy("feature", "_r").orderBy("value")
        cum = cells.withColumn("cum", F.sum("n").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
        asked = spark.createDataFrame(targets, "feature int, _r double, prob int, side int, rank long")
        hits = cum.join(F.broadcast(asked), ["feature", "_r"])  # two rows per column and probability
        hits = hits.where((F.col("cum") > F.col("rank")) & (F.col("cum") - F.col("n") <= F.col("rank")))
        for row in hits.select("feature", "prob", "side", "value").collect():
            found[row["feature"], row["prob"], row["side"]] = row["value"]
    rows = []
    for i, c in enumerate(columns):
        n = sum(counts[c].values())
        if not n:
            continue
        values = []
        for j, p in enumerate(probs):
            lo, hi, h = found[i, j, 0], found[i, j, 1], (n - 1) * p
            values.append(float(lo + (hi - lo) * (h - math.floor(h))))
        rows.append((c, n, *values))
    schema = "feature string, n long, " + ", ".join(f"q{j} double" for j in range(len(probs)))
    return spark.createDataFrame(rows, schema)


def hash_order(keys: Sequence[str | Column], seed: int) -> Column:
    """A reproducible pseudo-random order: hex digest of the key text and a seed."""
    return F.md5(F.concat_ws("|", *[col(k).cast("string") for k in keys], F.lit(str(seed))))


def hash_ranks(df: DataFrame, strata: Sequence[str], keys: Sequence[str], seed: int, out: str = "_rank") -> DataFrame:
    """1-based rank of each row in its stratum by `hash_order`, without a task per stratum.

    The first four digits of the digest cut every stratum into 65 536 even parts; ranks inside a part
    are shifted by the sizes of the earlier parts.  The keys decide the order alone, so they must be unique.
    """
    strata = list(strata)
    tagged = df.withColumn("_h", hash_order(keys, seed)).withColumn("_p", F.substring("_h", 1, 4))
    counts = tagged.groupBy(*strata, "_p").agg(F.count(F.lit(1)).alias("_c"))
    over = Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))
    before = over.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *strata,
        "_p",
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"),
        F.sum("_c").over(over).alias(f"{out}_n"),
    )
    ranked = _keyed(tagged, [*strata, "_p"]).withColumn(
        "_rn", F.row_number().over(Window.partitionBy("_key").orderBy("_h", *keys)).cast("long")
    )
    joined = _join_small_key(ranked, offsets, [*strata, "_p"])
    return joined.withColumn(out, F.col("_rn") + F.col("_off")).drop("_h", "_p", "_rn", "_off")


def hash_pieces(
    df: DataFrame, stratum: str, keys: Sequence[str], seed: int, bounds: dict[object, Sequence[int]], out: str = "_piece"
) -> DataFrame:
    """Add the number of `bounds` of its stratum that lie below a row's rank by `hash_order`.

    Only the counts of the digest's first four digits move; a bound becomes a prefix, and just the rows
    with that very prefix are ranked.  `bounds` has ascending ranks for each of the (few) strata.
    """
    tagged = df.withColumn("_h", hash_order(keys, seed)).withColumn("_p", F.substring("_h", 1, 4))
    counts = tagged.groupBy(stratum, "_p").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(stratum).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    crossing = None
    for value, ranks in bounds.items():
        for rank in ranks:
            hit = F.col(stratum).eqNullSafe(F.lit(value)) & (F.col("_before") < rank) & (F.col("_before") + F.col("_c") > rank)
            crossing = hit if crossing is None else crossing | hit
    ends = placed.where(crossing).collect() if crossing is not None else []  # one row per bound
    reached = {}
    for value, ranks in bounds.items():
        exact = placed.where(F.col(stratum).eqNullSafe(F.lit(value)))
        for rank in ranks:
            cut = next((r for r in ends if r[stratum] == value and r["_before"] < rank < r["_before"] + r["_c"]), None)
            if cut:
                reached[value, rank] = (cut["_p"], rank - cut["_before"])
            else:  # the bound falls between two prefixes
                first = exact.where(F.col("_before") >= rank).agg(F.min("_p")).first()[0]
                reached[value, rank] = (first or "g", 0)
    edges = {(value, prefix) for (value, _), (prefix, open_) in reached.items() if open_}
    on_edge = F.lit(False)
    for value, prefix in sorted(edges, key=repr):
        on_edge = on_edge | (F.col(stratum).eqNullSafe(F.lit(value)) & (F.col("_p") == prefix))
    on_edge = F.col("_p").isin(sorted({prefix for _, prefix in edges})) & on_edge  # a filter works out the digest and the stratum wherever it names them

    def piece(inner: Column) -> Column:
        number = F.lit(0)
        for value, ranks in bounds.items():
            for rank in ranks:
                prefix, open_ = reached[value, rank]
                above = (F.col("_p") > prefix) | ((F.col("_p") == prefix) & (inner > open_))
                number = number + F.when(F.col(stratum).eqNullSafe(F.lit(value)) & above, 1).otherwise(0)
        return number

    plain = tagged.where(~on_edge).withColumn(out, piece(F.lit(1)))
    if not edges:
        return plain.drop("_h", "_p")
    ranked = tagged.where(on_edge).withColumn("_rn", F.row_number().over(Window.partitionBy(stratum, "_p").orderBy("_h", *keys)))
    edge = ranked.withColumn(out, piece(F.col("_rn"))).drop("_rn")
    return plain.unionByName(edge).drop("_h", "_p")


def value_at(df: DataFrame, rank: int, ts: str, tie: str) -> tuple | None:
    """(ts, tie) of the row at a 0-based rank in time order, by counts per day and the rows of one day."""
    days = df.groupBy(time_bucket(ts, 86_400).alias("_day")).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)  # one row per day
    day = days.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    hit = day.where((F.col("_before") <= rank) & (F.col("_before") + F.col("_c") > rank)).first()
    if hit is None:
        return None
    inside = df.where(time_bucket(ts, 86_400).eqNullSafe(F.lit(hit["_day"]))).select(ts, tie)
    found = positions(inside, [], ts, tie, bucket_seconds=60).where(F.col("_pos") == rank - hit["_before"]).first()
    return found[ts], found[tie]
