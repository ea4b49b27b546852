"""Distribution drift between a reference and a current table."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerogrid.operators.ordering import accumulate, long_cells


def ks_statistic(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per column.

    Both samples are summed per distinct value (ties collapse map-side), then cumulated over value
    ranges; the distance is read at the last row of each tie, which is the only row of the value.
    """
    both = reference.select(*columns, F.lit(1).alias("_ref"), F.lit(0).alias("_cur")).unionByName(
        current.select(*columns, F.lit(0).alias("_ref"), F.lit(1).alias("_cur"))
    )
    cells = long_cells(both, columns, [], {"n_ref": F.col("_ref"), "n_cur": F.col("_cur")})
    cum = accumulate(cells, ["feature"], "value", ["n_ref", "n_cur"])
    distance = F.abs(
        F.try_divide(F.col("n_ref_cum"), F.col("n_ref_total")) - F.try_divide(F.col("n_cur_cum"), F.col("n_cur_total"))
    )
    return cum.groupBy("feature").agg(
        F.max("n_ref_total").alias("n_ref"), F.max("n_cur_total").alias("n_cur"), F.max(distance).alias("ks")
    )


def chi2_statistic(
    reference: DataFrame, current: DataFrame, columns: Sequence[str], bins: int = 10, counts: bool = False
) -> DataFrame:
    """Chi-square distance of the histograms over the pooled range, per column.

    The histograms are normalised to proportions before the statistic, so it stays small whatever the
    sample size; `counts=True` gives the usual statistic on counts.
    """
    both = reference.select(*columns, F.lit(1).alias("_ref"), F.lit(0).alias("_cur")).unionByName(
        current.select(*columns, F.lit(0).alias("_ref"), F.lit(1).alias("_cur"))
    )
    row = both.agg(*[e for c in columns for e in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]).first()
    entries = []
    for c in columns:
        lo, hi = row[f"lo_{c}"], row[f"hi_{c}"]
        if lo is None:
            continue
        width = (hi - lo) / bins or 1.0 / bins
        index = F.least(F.floor((F.col(c) - F.lit(float(lo))) / F.lit(float(width))), F.lit(bins - 1))
        entries.append(F.struct(F.lit(c).alias("feature"), index.cast("int").alias("bin")))
    long = both.select("_ref", "_cur", F.explode(F.array(*entries)).alias("_e")).where(F.col("_e.bin").isNotNull())
    hist = long.groupBy("_e.feature", "_e.bin").agg(
        F.sum("_ref").cast("double").alias("r"), F.sum("_cur").cast("double").alias("c")
    )
    listed = hist.groupBy("feature").agg(
        F.sum("r").alias("nr"), F.sum("c").alias("nc"), F.collect_list(F.struct("r", "c")).alias("cells")
    )  # at most `bins` cells per feature
    scale_c, scale_r = (
        (F.lit(1.0), F.try_divide(F.col("nc"), F.col("nr")))
        if counts
        else (F.try_divide(F.lit(1.0), F.col("nc")), F.try_divide(F.lit(1.0), F.col("nr")))
    )
    eps = F.lit(1e-10)
    term = lambda x: F.pow(x["c"] * scale_c - x["r"] * scale_r, F.lit(2.0)) / (x["r"] * scale_r + eps)
    return listed.select(
        "feature", F.aggregate("cells", F.lit(0.0), lambda a, x: a + term(x)).alias("chi2")
    )


def ks_p_value(d: float, n_ref: int, n_cur: int) -> float:
    """Asymptotic two-sided p-value."""
    t = d * math.sqrt(n_ref * n_cur / (n_ref + n_cur))
    if t < 0.2:
        return 1.0
    total = 2.0 * sum((-1) ** (k - 1) * math.exp(-2.0 * k * k * t * t) for k in range(1, 101))
    return min(1.0, max(0.0, total))


def chi2_p_value(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution, by the recurrence of the incomplete gamma function."""
    h = x / 2.0
    if df % 2:
        tail, a = math.erfc(math.sqrt(h)), 0.5
    else:
        tail, a = math.exp(-h), 1.0
    while a < df / 2.0 - 0.25:
        tail += math.exp(a * math.log(h) - h - math.lgamma(a + 1.0)) if h > 0 else 0.0
        a += 1.0
    return min(1.0, tail)


def drift_report(
    reference: DataFrame, current: DataFrame, columns: Sequence[str], threshold: float = 0.05, bins: int = 10
) -> DataFrame:
    """Statistics, p-values, score and verdict per column; one row per column comes to the driver."""
    stats = ks_statistic(reference, current, columns).join(chi2_statistic(reference, current, columns, bins), "feature")
    rows = []
    for s in stats.collect():
        p_ks = ks_p_value(s["ks"], s["n_ref"], s["n_cur"])
        p_chi = chi2_p_value(s["chi2"], bins - 1)
        low = min(p_ks, p_chi)
        rows.append((s["feature"], s["ks"], p_ks, s["chi2"], p_chi, 1.0 - low, low < threshold))
    overall = sum(r[-1] for r in rows) > 0.3 * len(rows)
    return reference.sparkSession.createDataFrame(
        [(*r, overall) for r in rows],
        "feature string, ks double, ks_p double, chi2 double, chi2_p double, drift_score double, drifted boolean, "
        "overall_drift boolean",
    )
