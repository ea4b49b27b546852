"""Fit / transform preprocessing.

A fit reduces the table to a few numbers per column (exact where the definition is exact) and the
transform uses them as literals, so transforming is one projection without a join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerogrid.functions.num import clip, flag, right_closed
from aerogrid.functions.weather import wind_quadrant
from aerogrid.operators.ordering import exact_quantiles, positions



# ---------------------------------------------------------------- scalar fits


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float]]:
    """Exact quantiles per column as plain numbers (one row per column comes to the driver)."""
    rows = exact_quantiles(df.select(*columns), columns, probs).collect()
    found = {r["feature"]: [r[f"q{i}"] for i in range(len(probs))] for r in rows}
    return {c: found.get(c, [None] * len(probs)) for c in columns}


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    return {c: q[0] for c, q in quantiles(df, columns, [0.5]).items()}


def most_frequent(df: DataFrame, column: str):
    """Most frequent value, the smallest one on a tie."""
    top = (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("_c"))
        .orderBy(F.desc("_c"), F.asc(column))
        .limit(1)
        .collect()
    )
    return top[0][0] if top else None


def distinct_values(df: DataFrame, column: str) -> list:
    """Sorted distinct values of a column; each becomes a column name, so they come to the driver."""
    rows = df.where(F.col(column).isNotNull()).select(column).distinct().collect()
    return sorted(r[0] for r in rows)


# ---------------------------------------------------------------- imputation and cleaning


def impute(df: DataFrame, numeric: Sequence[str] = (), categorical: Sequence[str] = ()) -> DataFrame:
    """Missing numbers become the column median, missing categories the most frequent one."""
    fills: dict = {c: m for c, m in medians(df, numeric).items() if m is not None} if numeric else {}
    for c in categorical:
        value = most_frequent(df, c)
        if value is not None:
            fills[c] = value
    return df.fillna(fills) if fills else df


def fill_zero(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.fillna(0, subset=list(columns) if columns is not None else None)


def clean_wind_direction(df: DataFrame, column: str) -> DataFrame:
    """Flag variable wind, read the rest as numbers, and fill what is no number with the median."""
    number = F.col(column).try_cast("double")
    parsed = df.withColumn("variable_wind", flag(F.col(column) == "VRB")).withColumn(column, number)
    median = medians(parsed, [column])[column]
    return parsed if median is None else parsed.fillna({column: median})


def wind_quadrants(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Indicator columns of the four direction quadrants; texts take the most frequent number."""
    number = F.col(column).try_cast("double")
    top = most_frequent(df.select(number.alias(column)), column)
    quadrant = wind_quadrant(F.coalesce(number, F.lit(top).cast("double")))
    tagged = df.withColumn("_q", quadrant)
    return tagged.select(*df.columns, *[flag(F.col("_q") == i).alias(f"{prefix}_{i}") for i in range(1, 5)])


def one_hot(
    df: DataFrame, column: str, prefix: str, values: Sequence | None = None, drop_first: bool = False
) -> DataFrame:
    """One 0/1 column per value, named prefix_value, after the existing columns.

    For a column with thousands of values `one_hot_vector` is the lighter form.
    """
    values = list(values) if values is not None else distinct_values(df, column)
    if drop_first:
        values = values[1:]
    return df.select("*", *[flag(F.col(column) == v).alias(f"{prefix}_{v}") for v in values])


def one_hot_vector(df: DataFrame, column: str, out: str, drop_first: bool = False) -> DataFrame:
    """The indicators of `one_hot` as one sparse vector, for any number of values; missing values have none set."""
    indexer = StringIndexer(inputCol=column, outputCol="_index", handleInvalid="keep", stringOrderType="alphabetAsc").fit(df)
    n = len(indexer.labels)
    place = F.col("_index")
    if drop_first:  # the first value goes with the missing ones, to the end
        n = max(n - 1, 0)
        place = F.when(place.isin(0.0, n + 1.0), float(n)).otherwise(place - 1.0)
    sizes = {"ml_attr": {"type": "nominal", "name": "_place", "num_vals": n + 1}}
    placed = indexer.transform(df).withColumn("_place", place).drop("_index").withMetadata("_place", sizes)
    # the last place is that of the missing values, which the encoder drops, so nothing is done per value and row
    return OneHotEncoder(inputCol="_place", outputCol=out, dropLast=True).fit(placed).transform(placed).drop("_place")


def vector_place(vector: str) -> Column:
    """(place, size) of a one-hot vector, from its sparse form: the place that is set, -1 if none is."""

    @F.udf("place long, size long")
    def place(v):
        return (int(v.indices[0]) if len(v.indices) else -1, v.size)

    return place(vector)


def target_encode(df: DataFrame, column: str, target: str, smoothing: float = 10.0) -> DataFrame:
    """m-estimate target encoding: (sum of target + m * global mean) / (rows + m) per category.

    The category table has one row per category and is joined back; the optimizer broadcasts it when
    it is small at run time, and skewed categories are split by the adaptive join otherwise.
    """
    totals = df.agg(F.avg(F.col(target).cast("double")).alias("m")).first()
    prior = float(totals["m"]) if totals["m"] is not None else 0.0
    stats = df.groupBy(column).agg(F.sum(F.col(target).cast("double")).alias("_s"), F.count(target).alias("_c"))
    encoded = (F.col("_s") + F.lit(smoothing * prior)) / (F.col("_c") + F.lit(smoothing))
    stats = stats.select(F.col(column).alias("_key"), encoded.alias(f"{column}_encoded"))
    return df.join(stats, df[column].eqNullSafe(stats["_key"]), "left").drop("_key")


# ---------------------------------------------------------------- scaling


@dataclass
class Scaler:
    """Affine scaling per column: (x - centre) / scale."""

    method: str = "standard"
    centre: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)

    def fit(self, df: DataFrame, columns: Sequence[str]) -> Scaler:
        if self.method == "robust":
            qs = quantiles(df, columns, [0.25, 0.5, 0.75])
            self.centre = {c: q[1] for c, q in qs.items()}
            self.scale = {c: q[2] - q[0] for c, q in qs.items()}
        else:
            row = df.agg(*[e for c in columns for e in _scale_terms(c, self.method)]).first()
            self.centre = {c: row[f"c_{c}"] for c in columns}
            self.scale = {c: row[f"s_{c}"] for c in columns}
        self.scale = {c: (s if s else 1.0) for c, s in self.scale.items()}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(self.centre[c])) / F.lit(self.scale[c]) for c in self.centre})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * F.lit(self.scale[c]) + F.lit(self.centre[c]) for c in self.centre})


def _scale_terms(c: str, method: str) -> list[Column]:
    """Centre and scale of one column as aggregates (population deviation for `standard`)."""
    x = F.col(c).cast("double")
    if method == "standard":
        return [F.avg(x).alias(f"c_{c}"), F.stddev_pop(x).alias(f"s_{c}")]
    if method == "minmax":
        return [F.min(x).alias(f"c_{c}"), (F.max(x) - F.min(x)).alias(f"s_{c}")]
    if method == "maxabs":
        return [F.lit(0.0).alias(f"c_{c}"), F.max(F.abs(x)).alias(f"s_{c}")]
    if method == "robust":
        return [
            F.percentile(x, F.lit(0.5)).alias(f"c_{c}"),
            (F.percentile(x, F.lit(0.75)) - F.percentile(x, F.lit(0.25))).alias(f"s_{c}"),
        ]
    raise ValueError(f"unknown scaling {method}")


@dataclass
class BlockScaler:
    """Separate scaling for every `window` consecutive rows of a series.

    The fitted table has one row per (station, block).  Blocks it does not know take the last known
    block of the station.  A block holds at most `window` rows, so its quantiles are taken inside it.
    """

    method: str
    window: int
    columns: Sequence[str]
    ts: str = "ts"
    tie: str = "event_id"
    table: DataFrame | None = None

    def _blocks(self, df: DataFrame) -> DataFrame:
        placed = positions(df, ["station"], self.ts, self.tie)
        return placed.withColumn("block", F.floor(F.col("_pos") / F.lit(self.window)).cast("long")).drop("_pos")

    def fit(self, df: DataFrame) -> BlockScaler:
        terms = [e for c in self.columns for e in _scale_terms(c, self.method)]
        stats = self._blocks(df).groupBy("station", "block").agg(*terms)
        fixed = {f"s_{c}": F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}")) for c in self.columns}
        self.table = stats.withColumns(fixed)
        return self

    def _with_stats(self, df: DataFrame) -> DataFrame:
        last = self.table.groupBy("station").agg(F.max("block").alias("_last"))
        placed = self._blocks(df).join(last, "station")
        placed = placed.withColumn("_use", F.least("block", "_last"))
        return placed.join(self.table.withColumnRenamed("block", "_use"), ["station", "_use"], "left")

    def transform(self, df: DataFrame) -> DataFrame:
        joined = self._with_stats(df)
        scaled = {c: (F.col(c) - F.col(f"c_{c}")) / F.col(f"s_{c}") for c in self.columns}
        return joined.withColumns(scaled).select(*df.columns, "block")

    def inverse(self, df: DataFrame) -> DataFrame:
        joined = self._with_stats(df)
        back = {c: F.col(c) * F.col(f"s_{c}") + F.col(f"c_{c}") for c in self.columns}
        return joined.withColumns(back).select(*df.columns, "block")


# ---------------------------------------------------------------- outliers and bins


@dataclass
class OutlierBounds:
    """Bounds from the quartiles or from mean and sample deviation; values are clipped or emptied."""

    method: str = "iqr"
    threshold: float = 1.5
    handling: str = "clip"
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)

    def fit(self, df: DataFrame, columns: Sequence[str]) -> OutlierBounds:
        if self.method == "iqr":
            for c, (q1, q3) in quantiles(df, columns, [0.25, 0.75]).items():
                self.bounds[c] = (q1 - self.threshold * (q3 - q1), q3 + self.threshold * (q3 - q1))
        elif self.method == "zscore":
            aggs = [e for c in columns for e in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))]
            row = df.agg(*aggs).first()
            for c in columns:
                m, s = row[f"m_{c}"], row[f"s_{c}"]
                self.bounds[c] = (m - self.threshold * s, m + self.threshold * s)
        else:
            raise ValueError(f"unknown outlier method {self.method}")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, (lo, hi) in self.bounds.items():
            if self.handling == "clip":
                out[c] = clip(c, lo, hi)
            else:
                out[c] = F.when(F.col(c).between(F.lit(lo), F.lit(hi)), F.col(c))
        return df.withColumns(out)


def clip_flagged(df: DataFrame, flag_column: str, columns: Sequence[str]) -> DataFrame:
    """Rows marked by a detector are clipped to the 1 % and 99 % quantiles of each column."""
    qs = quantiles(df, columns, [0.01, 0.99])
    return df.withColumns(
        {c: F.when(F.col(flag_column) == 1, clip(c, *qs[c])).otherwise(F.col(c)) for c in columns}
    )


@dataclass
class QuantileBins:
    """Quantile edges per column, fitted only where there are more distinct values than bins."""

    bins: int = 10
    edges: dict[str, list[float]] = field(default_factory=dict)

    def fit(self, df: DataFrame, columns: Sequence[str]) -> QuantileBins:
        rough = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
        close = [c for c in columns if self.bins / 2 <= rough[c] <= 2 * self.bins]
        exact = df.agg(*[F.count_distinct(c).alias(c) for c in close]).first() if close else {}
        wide = [c for c in columns if (exact[c] if c in close else rough[c]) > self.bins]
        if wide:
            probs = [i / self.bins for i in range(self.bins + 1)]
            self.edges = {c: sorted(set(q)) for c, q in quantiles(df, wide, probs).items()}
        return self

    def bin(self, c: str) -> Column:
        """Bin number; right-closed, with the lowest edge in bin 0 and null outside the edges."""
        e = self.edges[c]
        inner = right_closed(c, [float("-inf"), *e[1:]], list(range(len(e) - 1)))
        return F.when((F.col(c) >= F.lit(e[0])) & (F.col(c) <= F.lit(e[-1])), inner)

    def transform(self, df: DataFrame, indicators: bool = False) -> DataFrame:
        out = df.withColumns({f"{c}_bin": self.bin(c) for c in self.edges})
        if indicators:
            for c, e in self.edges.items():
                out = one_hot(out, f"{c}_bin", f"{c}_bin", values=range(len(e) - 1))
        return out


def polynomial(df: DataFrame, columns: Sequence[str], squares: bool = True) -> DataFrame:
    """Degree-2 terms in the usual order: a², ab, ac, b², bc, c² (pairs only without `squares`)."""
    made = []
    for i, a in enumerate(columns):
        for b in columns[i if squares else i + 1 :]:
            made.append((F.col(a) * F.col(b)).alias(f"{a}^2" if a == b else f"{a} {b}"))
    return df.select("*", *made)




def row_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, sample deviation, extremes and range over the known values of a row (more than three columns)."""
    if len(columns) <= 3:
        return df
    values = F.array_compact(F.array(*[F.col(c).cast("double") for c in columns]))
    n = F.size("_v")
    total = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x)
    with_mean = df.withColumn("_v", values).withColumn("row_mean", F.when(n > 0, total / n))
    spread = F.aggregate("_v", F.lit(0.0), lambda a, x: a + (x - F.col("row_mean")) * (x - F.col("row_mean")))
    return (
        with_mean.withColumn("row_std", F.when(n > 1, F.sqrt(spread / (n - 1))))
        .withColumn("row_max", F.array_max("_v"))
        .withColumn("row_min", F.array_min("_v"))
        .withColumn("row_range", F.col("row_max") - F.col("row_min"))
        .drop("_v")
    )
