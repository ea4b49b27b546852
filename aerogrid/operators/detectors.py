"""Outlier detectors that score every row of a distributed table."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerogrid.operators import drift, reduction
from aerogrid.operators.ordering import exact_quantiles, grouped
from aerogrid.session import settle


def flag_highest(df: DataFrame, score: str, share: float, out: str) -> DataFrame:
    """Flag the rows whose score exceeds the exact (1 - share) quantile."""
    row = exact_quantiles(df.select(score), [score], [1.0 - share]).first()
    return df.withColumn(out, (F.col(score) > F.lit(row["q0"] if row else None)).cast("int"))


# ---------------------------------------------------------------- isolation forest


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int) -> dict:
    """One isolation tree as nested nodes; leaves carry their size."""
    low, high = x.min(axis=0), x.max(axis=0)
    open_columns = np.flatnonzero(high > low)
    if depth == 0 or len(x) <= 1 or len(open_columns) == 0:
        return {"size": int(len(x))}
    c = int(rng.choice(open_columns))
    cut = float(rng.uniform(low[c], high[c]))
    left = x[:, c] < cut
    return {
        "column": c,
        "cut": cut,
        "left": _grow(x[left], rng, depth - 1),
        "right": _grow(x[~left], rng, depth - 1),
    }


def _mean_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    return 2.0 * (np.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n if n > 2 else 1.0


def _paths(node: dict, x: np.ndarray, depth: float) -> np.ndarray:
    if "size" in node:
        return np.full(len(x), depth + _mean_path(node["size"]))
    out = np.empty(len(x))
    left = x[:, node["column"]] < node["cut"]
    out[left] = _paths(node["left"], x[left], depth + 1.0)
    out[~left] = _paths(node["right"], x[~left], depth + 1.0)
    return out


def sample_limit(rows: int, sample: int) -> int:
    """The 64-bit hash value up to which about twice `sample` of `rows` rows lie."""
    return -(1 << 63) + min((1 << 64) - 1, (2 * sample << 64) // max(rows, 1))


def fit_isolation_forest(
    df: DataFrame, columns: Sequence[str], key: str, trees: int = 100, sample: int = 256, seed: int = 42
) -> list[str]:
    """Trees grown in parallel, each on its own `sample` rows; a forest is a few hundred small texts.

    A row belongs to the samples its key hashes into.  The hash admits about twice the rows needed and
    the lowest hashes of each tree are kept, so no tree ever sees more.
    """
    columns = list(columns)
    n = df.count()
    limit = sample_limit(n, sample)
    draws = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.xxhash64(F.col(key), t, F.lit(seed)) <= F.lit(limit)
    )
    rows = df.select(F.explode(draws).alias("tree"), key, *[F.col(c).cast("double").alias(c) for c in columns])
    order = Window.partitionBy("tree").orderBy(F.xxhash64(F.col(key), F.lit(seed), F.col("tree")), key)
    samples = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample)
    depth = int(np.ceil(np.log2(max(sample, 2))))

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        number = int(group["tree"].iloc[0])
        x = group.sort_values("_n")[columns].fillna(0.0).to_numpy()
        tree = _grow(x, np.random.default_rng(seed + number), depth)
        return pd.DataFrame({"tree": [number], "model": [json.dumps({"rows": len(x), "root": tree})]})

    grown = samples.groupBy("tree").applyInPandas(grow, "tree int, model string")
    return [r["model"] for r in grown.orderBy("tree").collect()]


def isolation_scores(df: DataFrame, columns: Sequence[str], forest: Sequence[str], out: str = "score") -> DataFrame:
    """Isolation score of every row (near 1 = easily isolated), in Arrow batches."""
    models = [json.loads(m) for m in forest]
    scale = float(np.mean([_mean_path(m["rows"]) for m in models])) or 1.0

    @F.pandas_udf("double")
    def score(*series: pd.Series) -> pd.Series:
        x = np.column_stack([s.fillna(0.0).to_numpy(dtype=float) for s in series])
        mean = np.mean([_paths(m["root"], x, 0.0) for m in models], axis=0)
        return pd.Series(np.power(2.0, -mean / scale))

    return df.withColumn(out, score(*[F.col(c).cast("double") for c in columns]))


# ---------------------------------------------------------------- robust covariance


def _moments(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    index = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in index],
    ).first()
    mean = np.array([row[f"m{i}"] or 0.0 for i in range(len(columns))])
    cov = np.zeros((len(columns), len(columns)))
    for i, j in index:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] or 0.0
    return mean, cov


def _distance(columns: Sequence[str], mean: np.ndarray, cov: np.ndarray) -> Column:
    """Squared Mahalanobis distance as a column expression."""
    values, vectors = np.linalg.eigh(np.linalg.pinv(cov))
    total = F.lit(0.0)
    for value, vector in zip(values, vectors.T):
        total = total + F.lit(float(max(value, 0.0))) * F.pow(reduction.linear(columns, vector, mean), F.lit(2.0))
    return total


SAMPLE = 2_000  # rows, by hash, on which the starts are tried
STARTS, BEST = 50, 3  # small subsets tried on the sample, and how many of them are followed over all rows


def _chi2_quantile(share: float, df: int) -> float:
    low, high = 0.0, 10.0 * df + 100.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1.0 - drift.chi2_p_value(mid, df) < share else (low, mid)
    return (low + high) / 2


def _volume(cov: np.ndarray) -> float:
    """Logarithm of the determinant; of a flat cloud minus infinity."""
    sign, log = np.linalg.slogdet(cov)
    return float(log) if sign > 0 else -np.inf


def _starts(x: np.ndarray, support: float, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Centres and covariances of the best of many small subsets after two concentration steps on the sample."""
    rng, found = np.random.default_rng(seed), []
    keep = max(int(np.ceil(support * len(x))), min(len(x), x.shape[1] + 1))
    for _ in range(STARTS):
        own = rng.choice(len(x), min(len(x), x.shape[1] + 1), replace=False)
        for _ in range(3):
            mean, cov = x[own].mean(axis=0), np.atleast_2d(np.cov(x[own].T, bias=True))
            off = x - mean
            own = np.argsort(((off @ np.linalg.pinv(cov)) * off).sum(axis=1), kind="stable")[:keep]
        found.append((_volume(np.atleast_2d(np.cov(x[own].T, bias=True))), x[own].mean(axis=0), np.atleast_2d(np.cov(x[own].T, bias=True))))
    found.sort(key=lambda f: f[0])
    return [(mean, cov) for _, mean, cov in found[:BEST]]


def robust_distance(
    df: DataFrame, columns: Sequence[str], support: float = 0.5, rounds: int = 10, out: str = "distance", seed: int = 42
) -> DataFrame:
    """Squared Mahalanobis distance to the centre of the `support` share of rows with the smallest covariance.

    Small subsets of a sample give the starts.  The best are followed over all rows: the distance at the exact quantile, then the
    moments of the rows inside, until the determinant falls no more.  The covariance is then made consistent by the median distance,
    and mean and covariance are taken once more of all rows within the 97.5 % distance.
    """
    columns = list(columns)
    numbers = settle(df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna().withColumn("_row", F.monotonically_increasing_id()))
    total = numbers.count()
    if not total:
        return df.withColumn(out, F.lit(None).cast("double"))
    drawn = numbers.where(F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_row"), 11) / F.lit(float(1 << 53)) < min(1.0, SAMPLE / total))
    best = None
    for mean, cov in _starts(drawn.select(columns).toPandas().to_numpy(float) if total > SAMPLE else numbers.select(columns).toPandas().to_numpy(float), support, seed):
        volume = np.inf
        for _ in range(rounds):
            measured = numbers.withColumn("_d", _distance(columns, mean, cov))
            cut = exact_quantiles(measured.select("_d"), ["_d"], [support]).first()["q0"]
            mean, cov = _moments(measured.where(F.col("_d") <= cut), columns)
            before, volume = volume, _volume(cov)
            if not volume < before - 1e-9:
                break
        if best is None or volume < best[0]:
            best = (volume, mean, cov)
    _, mean, cov = best
    median = exact_quantiles(numbers.select(_distance(columns, mean, cov).alias("_d")), ["_d"], [0.5]).first()["q0"]
    cov = cov * (median / _chi2_quantile(0.5, len(columns)))
    near = numbers.where(_distance(columns, mean, cov) < _chi2_quantile(0.975, len(columns)))
    again = _moments(near, columns)
    if _volume(again[1]) > -np.inf:
        mean, cov = again
    return df.withColumn(out, _distance(columns, mean, cov))


# ---------------------------------------------------------------- local density

MOST_CELLS = 500_000  # about; their bounds go to every task


class _Space:
    """Cells of space from halving boxes: cell c is halved into 2 c (up to the cut) and 2 c + 1, the whole is 1."""

    def __init__(self, rules: dict[int, tuple[int, float]]):
        inner = sorted(rules.items())
        self.inner = np.array([c for c, _ in inner], np.int64)
        self.axis = np.array([a for _, (a, _) in inner], np.int64)
        self.cut = np.array([v for _, (_, v) in inner])
        self.boxes: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}  # lowest, highest corner and rows, of halved cells too

    def cells(self, x: np.ndarray) -> np.ndarray:
        cell, rows = np.ones(len(x), np.int64), np.arange(len(x))
        while len(rows) and len(self.inner):
            at = np.minimum(np.searchsorted(self.inner, cell[rows]), len(self.inner) - 1)
            halved = self.inner[at] == cell[rows]
            rows, at = rows[halved], at[halved]
            cell[rows] = 2 * cell[rows] + (x[rows, self.axis[at]] > self.cut[at])
        return cell

    def bound(self, found: list[tuple[int, np.ndarray, np.ndarray, int]]) -> None:
        """Take the bounds of the filled cells, and from them those of the cells they come from."""
        level = {cell: (low, high, n) for cell, low, high, n in found}
        self.boxes = dict(level)
        for cell in sorted(self.inner, reverse=True):  # children have larger numbers
            parts = [self.boxes[c] for c in (2 * cell, 2 * cell + 1) if c in self.boxes]
            self.boxes[int(cell)] = (np.min([b[0] for b in parts], axis=0), np.max([b[1] for b in parts], axis=0), sum(b[2] for b in parts))

    def reach(self, x: np.ndarray, cell: int, k: int) -> np.ndarray:
        """A distance within which each point has k other rows: to the far corner of the smallest box with as many."""
        while cell > 1 and self.boxes[cell][2] <= k:
            cell //= 2
        low, high, _ = self.boxes[cell]
        return np.sqrt((np.maximum(np.abs(x - low), np.abs(x - high)) ** 2).sum(axis=1))

    def near(self, low: np.ndarray, high: np.ndarray, reach: float) -> list[int]:
        """Filled cells whose box is within `reach` of the given box."""
        halved, out, todo = set(self.inner.tolist()), [], [1]
        while todo:
            cell = todo.pop()
            box = self.boxes.get(cell)
            if box is None or (np.maximum(np.maximum(box[0] - high, low - box[1]), 0.0) ** 2).sum() > reach**2 * (1 + 1e-9):
                continue
            if cell in halved:
                todo += [2 * cell, 2 * cell + 1]
            else:
                out.append(cell)
        return out


def _halved(points: DataFrame, names: Sequence[str], most: int) -> _Space:
    """Halve cells of more than `most` points at the median of their widest column, level by level.

    Only the rules are kept between the levels; each level sums up the cells of the points where they stand.
    """
    rules: dict[int, tuple[int, float]] = {}
    while True:
        space = _Space(rules)
        stats = [F.struct((F.max(c) - F.min(c)).alias("wide"), F.lit(i).alias("axis"), F.percentile_approx(c, 0.5, 200).alias("mid"), F.max(c).alias("top")) for i, c in enumerate(names)]
        placed = points.withColumn("_cell", _cell_of(points, space, names))
        cells = placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"), F.array_max(F.array(*stats)).alias("_s")).where(F.col("_n") > most)
        found = cells.collect()  # one row for each cell that is halved
        if not found:
            return space
        for r in found:
            s = r["_s"]
            rules[r["_cell"]] = (s["axis"], s["mid"] if s["mid"] < s["top"] else float(np.nextafter(s["top"], -np.inf)))


def _cell_of(df: DataFrame, space: _Space, names: Sequence[str]) -> Column:
    shared = df.sparkSession.sparkContext.broadcast(space)

    @F.pandas_udf("long")
    def cell(*series: pd.Series) -> pd.Series:
        return pd.Series(shared.value.cells(np.column_stack([x.to_numpy(dtype=float) for x in series])))

    return cell(*[F.col(c) for c in names])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of all pairs; the same for a pair in whichever block it stands."""
    total = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        total += (a[:, i, None] - b[None, :, i]) ** 2
    return np.sqrt(total)


def _visits(shared, names: list[str], k: int):
    """(cell, id, x, reach): each point in its own cell and in all others that may hold one of its k nearest rows."""

    def run(batches):
        space = shared.value
        for rows in grouped(batches, ["_cell"]):
            own = rows["_cell"][0].as_py()
            x = np.column_stack([rows[c].to_numpy() for c in names])
            weight, ids = rows["_m"].to_numpy(), rows["_id"].to_numpy()
            reach = space.reach(x, own, k)
            if space.boxes[own][2] > k:
                for at in range(0, len(x), 256):
                    apart = _distances(x[at : at + 256], x)
                    order = np.argsort(apart, axis=1, kind="stable")
                    seen = np.cumsum(weight[order], axis=1) - 1  # without the row itself
                    kth = (seen >= k).argmax(axis=1)
                    reach[at : at + 256] = np.take_along_axis(apart, order, axis=1)[np.arange(len(apart)), kth]
            low, high, _ = space.boxes[own]
            for cell in space.near(low, high, float(reach.max())):
                a, b, _ = space.boxes[cell]
                gap = np.sqrt((np.maximum(np.maximum(a - x, x - b), 0.0) ** 2).sum(axis=1))
                go = np.flatnonzero((gap <= reach * (1 + 1e-9)) | (cell == own))
                if len(go):
                    columns = [pa.array(np.full(len(go), cell)), pa.array(ids[go]), *(pa.array(x[go, i]) for i in range(len(names))), pa.array(reach[go])]
                    yield pa.RecordBatch.from_arrays(columns, ["_cell", "_id", *names, "_reach"])

    return run


def _nearest(names: list[str], k: int):
    """(id, near): of each visiting point the rows of the cell that can be among its k nearest, as (d, q, w)."""

    def run(batches):
        cell, at_home = None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            cells, kinds = batch["_cell"].to_numpy(), batch["_kind"].to_numpy()
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(batch)]) if len(batch) else []:
                part = table.slice(i, j - i)
                x = np.column_stack([part[c].to_numpy() for c in names])
                if kinds[i] == 0:
                    home = (x, part["_id"].to_numpy(), part["_m"].to_numpy())
                    at_home = home if cells[i] != cell else tuple(np.concatenate(z) for z in zip(at_home, home))
                    cell = cells[i]
                    continue
                out = []
                ids, reach = part["_id"].to_numpy(), part["_reach"].to_numpy()
                for at in range(0, len(x), 256):
                    apart = _distances(x[at : at + 256], at_home[0])
                    for row, d in enumerate(apart, at):
                        weight = at_home[2] - (at_home[1] == ids[row])
                        some = np.flatnonzero((d <= reach[row] * (1 + 1e-9)) & (weight > 0))
                        some = some[np.argsort(d[some], kind="stable")]
                        if not len(some):
                            continue
                        seen = np.cumsum(weight[some])
                        last = min(int(np.searchsorted(seen, k)), len(some) - 1)
                        some = some[d[some] <= d[some[last]]]
                        out.append((ids[row], [{"d": float(d[q]), "q": int(at_home[1][q]), "w": int(weight[q])} for q in some]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out]), pa.array([o[1] for o in out], _NEAR)], ["_id", "near"])

    return run


_NEAR = pa.list_(pa.struct([("d", pa.float64()), ("q", pa.int64()), ("w", pa.int64())]))
_NEAR_SQL = "array<struct<d: double, q: long, w: long>>"


def nearest_rows(points: DataFrame, names: Sequence[str], k: int, cell_rows: int = 2_000) -> DataFrame:
    """(id, kd, near) of distinct points (id, m copies, coordinates): the distance of the k-th nearest other row, and all rows within it.

    Exact: a point looks into its own cell first, which bounds the distance, and then into all cells whose box that distance reaches.
    Rows at the same distance as the k-th count as well; `near` has (distance, point, copies), a point's own other copies included.
    """
    names, spark = list(names), points.sparkSession
    space = _halved(points, names, max(cell_rows, points.count() // MOST_CELLS))
    placed = settle(points.withColumn("_cell", _cell_of(points, space, names)))
    corners = [f(c).alias(f"{n}{i}") for i, c in enumerate(names) for n, f in (("lo", F.min), ("hi", F.max))]
    found = placed.groupBy("_cell").agg(*corners, F.sum("_m").alias("n")).collect()  # one row per cell
    space.bound([(r["_cell"], np.array([r[f"lo{i}"] for i in range(len(names))]), np.array([r[f"hi{i}"] for i in range(len(names))]), r["n"]) for r in found])
    shared = spark.sparkContext.broadcast(space)
    coordinates = ", ".join(f"{c} double" for c in names)
    by_cell = placed.repartition("_cell").sortWithinPartitions("_cell")
    visits = by_cell.mapInArrow(_visits(shared, names, k), f"_cell long, _id long, {coordinates}, _reach double")
    both = placed.withColumn("_kind", F.lit(0)).unionByName(visits.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    dealt = both.repartition("_cell").sortWithinPartitions("_cell", "_kind")
    parts = dealt.mapInArrow(_nearest(names, k), f"_id long, near {_NEAR_SQL}")
    merged = parts.groupBy("_id").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0.0).alias("kd"))
    step = lambda acc, x: F.when(acc["seen"] >= k, acc).otherwise(F.struct((acc["seen"] + x["w"]).alias("seen"), x["d"].alias("kd")))
    reached = merged.withColumn("kd", F.aggregate("all", start, step)["kd"])
    return reached.select("_id", "kd", F.filter("all", lambda x: x["d"] <= F.col("kd")).alias("near"))


def local_outlier_scores(
    df: DataFrame, columns: Sequence[str], k: int = 20, out: str = "score", cell_rows: int = 2_000
) -> DataFrame:
    """Local outlier factor of every row: how much denser its k nearest rows lie than it does.

    Columns are scaled to unit deviation; missing values count as the mean.  Neighbours are exact, also across cells; rows at the
    same distance as the k-th count as neighbours too, and equal rows are one point with copies.  Without other rows the score is 1.
    """
    columns = list(columns)
    stats = df.agg(*[F.avg(c).alias(f"a{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    names = [f"_x{i}" for i in range(len(columns))]
    scaled = [
        (F.coalesce((F.col(c) - F.lit(stats[f"a{i}"])) / F.lit(stats[f"s{i}"] or 1.0), F.lit(0.0)) + F.lit(0.0)).alias(f"_x{i}")
        for i, c in enumerate(columns)
    ]
    rows = settle(df.select(*df.columns, *scaled))
    points = settle(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_m")).withColumn("_id", F.monotonically_increasing_id()))
    near = settle(nearest_rows(points, names, k, cell_rows))
    links = settle(near.select(F.col("_id").alias("p"), F.explode("near").alias("n")).select("p", "n.*"))
    reach = links.join(near.select(F.col("_id").alias("q"), "kd"), "q")
    mean_reach = F.sum(F.col("w") * F.greatest("kd", "d")) / F.sum("w")
    density = settle(reach.groupBy("p").agg((1.0 / (mean_reach + 1e-10)).alias("lrd")))
    around = links.join(density.select(F.col("p").alias("q"), "lrd"), "q").groupBy("p").agg((F.sum(F.col("w") * F.col("lrd")) / F.sum("w")).alias("_around"))
    factor = around.join(density, "p").select(F.col("p").alias("_id"), (F.col("_around") / F.col("lrd")).alias(out))
    scored = points.join(factor, "_id", "left").select(*names, F.coalesce(out, F.lit(1.0)).alias(out))
    return rows.join(scored, names).select(*df.columns, out)
