"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length in words.  A source is taken whole as often as its target allows;
what is left of the target is a subset-sum problem over its length counts: an even share of each length,
then the longest that still fit, then bounded-knapsack dynamic programming for the last words.  Which
documents of a length are taken follows a seeded hash of their ids; ranks are taken inside even parts of
the hash range, so no task sees all documents of a hot length.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerogrid.llm.common import broadcast_if_small
from aerogrid.session import settle

#: Fixed by the contract: the characters that part words, the weights and the repeats.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = 20
KNAPSACK_WORDS = 1 << 16
PART_BITS = 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fit_budget(counts: dict[int, int], budget: int, knapsack: int = KNAPSACK_WORDS) -> dict[int, int]:
    """How many documents of each length to take so that their words come as near to `budget` as found.

    `counts` holds the documents per length; the dynamic program covers the last `knapsack` words.
    """
    total = sum(n * c for n, c in counts.items())
    if budget >= total:
        return dict(counts)
    taken = {n: c * budget // total for n, c in counts.items()}
    left = budget - sum(n * c for n, c in taken.items())
    for n in sorted(counts, reverse=True):
        if left <= knapsack:
            break
        more = min(counts[n] - taken[n], left // n)
        taken[n] += more
        left -= more * n
    for n, c in _knapsack({n: counts[n] - taken[n] for n in counts if 0 < n <= 2 * left and counts[n] > taken[n]}, left).items():
        taken[n] += c
    return taken


def _knapsack(counts: dict[int, int], budget: int) -> dict[int, int]:
    """Bounded knapsack: bit i of `reach` says that i words can be made up; lots double in size.

    The sum nearest to the budget is taken, the lower one of two as near.
    """
    reach, lots = 1, []
    most = budget + max(counts, default=0)
    mask = (1 << (most + 1)) - 1
    for n in sorted(counts, reverse=True):
        rest, lot = min(counts[n], most // n), 1
        while rest > 0 and not reach >> budget & 1:
            lot = min(lot, rest)
            lots.append((n, lot, reach))
            reach |= reach << n * lot & mask
            rest, lot = rest - lot, lot * 2
    below = (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1
    above = reach >> (budget + 1)
    nearest_above = budget + (above & -above).bit_length() if above else None
    words = below if nearest_above is None or budget - below <= nearest_above - budget else nearest_above
    taken: dict[int, int] = {}
    for n, lot, before in reversed(lots):
        if not before >> words & 1:
            taken[n] = taken.get(n, 0) + lot
            words -= n * lot
    return taken


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    counts = {int(n): int(c) for n, c in zip(rows["size"], rows["n"], strict=True)}
    taken = fit_budget(counts, int(rows["rest"].iloc[0]))
    return pd.DataFrame({"_src": rows["_src"], "size": rows["size"], "take": [taken[int(n)] for n in rows["size"]]})


def _weighted(sources: DataFrame, weights: Sequence[int]) -> DataFrame:
    """Add `_w`: weights in turn, by code point of the source, null last."""
    spread = settle(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    offsets = offsets.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last()))
    place = (F.col("_off") + F.col("_i") - 1) % len(weights)
    ranked = spread.withColumn("_i", inside).join(F.broadcast(offsets), "_part")
    return ranked.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")).alias("_w"))


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Rows (source, source_size, target): shares by weight, at most `most` times a source's size.

    Sources above their limit get the limit, and what they leave is shared again by weight; each round
    needs two sums over the sources, and the level only rises.
    """
    weighted = settle(_weighted(sources, weights))
    limit, total = F.col("source_size") * most, weighted.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = limit <= F.col("_w") * level
        used, open_weight = weighted.agg(F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("_w")))).first()
        new = (total - (used or 0)) / open_weight if open_weight else level
        if new <= level:
            break
        level = new
    return weighted.select("source", "source_size", F.least(F.col("_w") * level, limit.cast("double")).alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST_REPEATS,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: id, size, source_size, target, taken (words, repeats counted).

    A null text has size 0; null sources form one source, the last; documents without words are never
    taken; repeated rows are taken one by one; an empty table gives an empty result; other columns are
    ignored.  The choice depends on ids, lengths and the seed only, so reruns agree.
    """
    rows = docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("_id"), word_count(F.col(text_col)).alias("size"))
    light = settle(rows.groupBy("source", "size", "_id").agg(F.count(F.lit(1)).alias("_c")))
    sizes = light.groupBy("source", "size").agg(F.sum("_c").alias("n"))
    goal = targets(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("_whole", whole).withColumn("rest", F.round(F.col("target") - F.col("_whole") * F.col("source_size")).cast("long"))
    goal = settle(goal.withColumn("_src", F.struct("source")))
    goal_here = broadcast_if_small(goal)
    counted = sizes.where("size > 0").withColumn("_src", F.struct("source")).join(goal_here.select("_src", "rest"), "_src")
    fitted = counted.select(F.to_json("_src").alias("_src"), "size", "n", "rest").groupBy("_src").applyInPandas(_fit_source, "_src string, size long, take long")
    chosen = _choose(light, settle(fitted.where("take > 0")), seed)
    copies = chosen.withColumn("_src", F.struct("source")).drop("source").join(goal_here, "_src")
    copies = copies.select("*", F.explode(F.sequence(F.lit(1), F.col("_c"))).alias("_i"))
    times = F.col("_whole") + (F.col("_i") <= F.col("_t")).cast("long")
    return copies.select(F.col("_id").alias(id_col), "size", "source_size", "target", (F.col("size") * times).alias("taken"))


def _choose(light: DataFrame, fitted: DataFrame, seed: int) -> DataFrame:
    """Add `_t`: how many of the `_c` equal rows are among the `take` first of their source and length, by hash."""
    hashed = light.withColumn("_src", F.to_json(F.struct("source"))).withColumn("_h", F.xxhash64(F.lit(seed), "_id"))
    hashed = hashed.withColumn("_part", F.shiftrightunsigned("_h", 64 - PART_BITS))
    parts = hashed.groupBy("_src", "size", "_part").agg(F.sum("_c").alias("_n"))
    running = Window.partitionBy("_src", "size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    cut = parts.join(broadcast_if_small(fitted), ["_src", "size"]).withColumn("_before", F.coalesce(F.sum("_n").over(running), F.lit(0)))
    cut = settle(cut.where(F.col("_before") < F.col("take")).select("_src", "size", "_part", "_n", (F.col("take") - F.col("_before")).alias("_open")))
    marked = hashed.join(broadcast_if_small(cut), ["_src", "size", "_part"], "left")
    split = F.col("_open") < F.col("_n")
    plain = marked.where(F.col("_open").isNull() | ~split).withColumn("_t", F.when(F.col("_open").isNull(), F.lit(0)).otherwise(F.col("_c")))
    earlier = Window.partitionBy("_src", "size", "_part").orderBy("_h", "_id").rowsBetween(Window.unboundedPreceding, -1)
    edge = marked.where(split).withColumn("_seen", F.coalesce(F.sum("_c").over(earlier), F.lit(0)))
    edge = edge.withColumn("_t", F.greatest(F.lit(0), F.least(F.col("_c"), F.col("_open") - F.col("_seen"))))
    kept = ["source", "size", "_id", "_c", "_t"]
    return plain.select(*kept).unionByName(edge.select(*kept))
