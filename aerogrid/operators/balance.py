"""Balancing and splitting.  Random choices follow a hash of the row key, so they repeat on every run."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerogrid.operators.ordering import hash_pieces, hash_ranks, value_at


def balance_windows(
    df: DataFrame, label: str, in_window: str, keys: Sequence[str], seed: int = 42, window_share: float = 0.7
) -> DataFrame:
    """All positives and as many negatives: `window_share` of them from inside the windows, if there are enough.

    Sizes are exact.  Where too few rows lie outside the windows all of them are taken.
    """
    stratum = (
        F.when(F.col(label) == 1, "positive").when(F.col(in_window) == 1, "window").otherwise("outside").alias("stratum")
    )
    tagged = df.select("*", stratum)
    sizes = {r["stratum"]: r["n"] for r in tagged.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).collect()}
    positives = sizes.get("positive", 0)
    from_window = min(sizes.get("window", 0), int(positives * window_share))
    from_outside = positives - from_window
    pieces = hash_pieces(tagged, "stratum", keys, seed, {"window": [from_window], "outside": [from_outside]})
    return pieces.where(F.col("_piece") == 0).drop("_piece")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Weight n / (classes * n_class) per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_t"), F.count(F.lit(1)).alias("_k"))
    return counts.join(F.broadcast(total), F.lit(True)).select(  # one row on the right
        label, "n", (F.col("_t") / (F.col("_k") * F.col("n"))).alias("weight")
    )


def with_class_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    rows = class_weights(df, label).collect()  # one row per class
    weight = None
    for r in rows:
        cond = F.col(label) == r[label]
        weight = F.when(cond, r["weight"]) if weight is None else weight.when(cond, r["weight"])
    return df.withColumn(out, weight)


def chronological_split(
    df: DataFrame, cuts: Sequence[float], names: Sequence[str], ts: str = "ts", tie: str = "event_id"
) -> DataFrame:
    """Split by exact time rank; `cuts` are shares of what the later cut leaves, last cut first.

    cuts [0.85, 0.82] with names [train, val, test] gives rows below int(int(n*0.85)*0.82) to train,
    below int(n*0.85) to val, the rest to test.
    """
    n = df.count()
    bounds = []
    for share in cuts:
        n = int(n * share)
        bounds.append(n)
    bounds.reverse()
    at, tied = F.col(ts), F.col(tie)
    split = F.lit(names[-1])
    for bound, name in reversed(list(zip(bounds, names))):
        cut = value_at(df, bound, ts, tie)
        if cut is None:  # no row lies beyond the bound
            split = F.lit(name)
            continue
        before = F.lit(True) if cut[0] is None else at.isNull() | (at < F.lit(cut[0])) | ((at == F.lit(cut[0])) & (tied < F.lit(cut[1])))
        split = F.when(before, name).otherwise(split)
    return df.withColumn("split", split)


def stratified_split(
    df: DataFrame, label: str, keys: Sequence[str], shares: Sequence[float], names: Sequence[str], seed: int = 42
) -> DataFrame:
    """Random split with the class shares kept; shares of the later parts are taken from the front."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()  # one row per class
    bounds = {}
    for r in sizes:
        upto, ranks = 0, []
        for share in shares:
            upto += math.floor(r["n"] * share + 0.5)
            ranks.append(upto)
        bounds[r[label]] = ranks
    pieces = hash_pieces(df, label, keys, seed, bounds)
    order = [*names[1:], names[0]]
    split = F.element_at(F.array(*[F.lit(x) for x in order]), F.col("_piece") + 1)
    return pieces.withColumn("split", split).drop("_piece")


def stratified_folds(df: DataFrame, label: str, keys: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Fold number 0..k-1, every class spread evenly."""
    ranked = hash_ranks(df, [label], keys, seed)
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % F.lit(k)).cast("int")).drop("_rank", "_rank_n")
