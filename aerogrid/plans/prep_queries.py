"""Imputation, scaling, outliers, bins, encodings and feature scores."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from aerogrid.functions.num import rnd
from aerogrid.operators import prep, selection
from aerogrid.plans.oracle_views import r
from aerogrid.plans.registry import query
from aerogrid.plans.window_queries import zeroed
from aerogrid.sources import standins as S

_FC = S.FEATURES
_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"]
_KEYS = ", ".join(_KEY)
_OBS3 = ["temperature_c", "visibility_m", "ceiling_ft"]


@query(
    "impute_median_and_mode",
    "X-01",
    """SELECT event_id, coalesce(wind_gust_kt, (SELECT median(wind_gust_kt) FROM obs)) AS wind_gust_kt,
 coalesce(ceiling_ft, (SELECT median(ceiling_ft) FROM obs)) AS ceiling_ft,
 coalesce(kind, (SELECT kind FROM k WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1)) AS kind FROM k""".replace(
        "SELECT event_id,", "WITH k AS (SELECT *, CASE WHEN visibility_m > 5000 THEN 'clear' WHEN visibility_m > 1500 THEN 'haze' END AS kind FROM obs) SELECT event_id,", 1
    ),
)
def _(spark, d):
    kind = F.when(F.col("visibility_m") > 5000, "clear").when(F.col("visibility_m") > 1500, "haze")
    obs = S.observations(spark, d).select("event_id", "wind_gust_kt", "ceiling_ft", kind.alias("kind"))
    return prep.impute(obs, ["wind_gust_kt", "ceiling_ft"], ["kind"])


@query(
    "fill_with_zero",
    "X-02",
    "SELECT event_id, coalesce(wind_gust_kt, 0) AS wind_gust_kt, coalesce(ceiling_ft, 0) AS ceiling_ft FROM obs",
)
def _(spark, d):
    obs = S.observations(spark, d).select("event_id", "wind_gust_kt", "ceiling_ft")
    return prep.fill_zero(obs, ["wind_gust_kt", "ceiling_ft"])


@query(
    "median_fill_of_lags",
    "X-08",
    """WITH l AS (SELECT event_id, lag(temperature_c, 24) OVER (PARTITION BY station ORDER BY ts, event_id) AS lagged FROM obs)
SELECT event_id, coalesce(lagged, (SELECT median(lagged) FROM l)) AS lagged FROM l""",
)
def _(spark, d):
    from aerogrid.operators.ordering import over_series

    lagged = over_series(
        S.observations(spark, d), lambda w: [F.lag("temperature_c", 24).over(w).alias("lagged")], back=24, keep=["event_id"]
    )
    return prep.impute(lagged, ["lagged"])


def _scaled_sql(centre, scale):
    cols = ", ".join(
        r(f"({c} - {centre.format(c=c)}) / (CASE WHEN {scale.format(c=c)} = 0 THEN 1 ELSE {scale.format(c=c)} END)", 5)
        + f" AS {c}"
        for c in _FC
    )
    return cols


_STATS = ", ".join(
    f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}, min({c}) AS lo_{c}, max({c}) AS hi_{c}, max(abs({c})) AS ma_{c}, "
    f"quantile_cont({c}, 0.25) AS q1_{c}, median({c}) AS q2_{c}, quantile_cont({c}, 0.75) AS q3_{c}"
    for c in _FC
)
for _method, _centre, _scale in [
    ("standard", "a_{c}", "s_{c}"),
    ("minmax", "lo_{c}", "(hi_{c} - lo_{c})"),
    ("robust", "q2_{c}", "(q3_{c} - q1_{c})"),
    ("maxabs", "0", "ma_{c}"),
]:

    @query(
        f"scale_{_method}",
        "X-03",
        f"WITH st AS (SELECT {_STATS} FROM features) SELECT l_orderkey, l_linenumber, {_scaled_sql(_centre, _scale)} FROM features, st",
    )
    def _(spark, d, method=_method):
        f = S.features(spark, d).select("l_orderkey", "l_linenumber", *_FC)
        out = prep.Scaler(method).fit(f, _FC).transform(f)
        return zeroed(out, ["l_orderkey", "l_linenumber"], 5)


@query(
    "scale_round_trip",
    "X-03",
    f"SELECT l_orderkey, l_linenumber, {', '.join(f'{r(c, 5)} AS {c}' for c in _FC)} FROM features",
)
def _(spark, d):
    f = S.features(spark, d).select("l_orderkey", "l_linenumber", *_FC)
    scaler = prep.Scaler("standard").fit(f, _FC)
    return zeroed(scaler.inverse(scaler.transform(f)), ["l_orderkey", "l_linenumber"], 5)


@query(
    "scale_by_weekly_blocks",
    "X-04",
    f"""WITH b AS (SELECT *, (row_number() OVER (PARTITION BY station ORDER BY ts, event_id) - 1) // 168 AS block FROM obs),
 s AS (SELECT station, block, {', '.join(f'avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}' for c in ('temperature_c', 'visibility_m'))} FROM b GROUP BY station, block)
SELECT event_id, b.block, {', '.join(r(f'({c} - a_{c}) / (CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END)', 5) + f' AS {c}' for c in ('temperature_c', 'visibility_m'))}
FROM b JOIN s ON b.station = s.station AND b.block = s.block""",
)
def _(spark, d):
    cols = ["temperature_c", "visibility_m"]
    obs = S.observations(spark, d).select("event_id", "station", "ts", *cols)
    out = prep.BlockScaler("standard", 168, cols).fit(obs).transform(obs)
    return zeroed(out.select("event_id", "block", *cols), ["event_id", "block"], 5)


@query(
    "clip_outliers_iqr",
    "X-05",
    f"WITH st AS (SELECT {_STATS} FROM features) SELECT l_orderkey, l_linenumber, "
    + ", ".join(
        r(f"greatest(q1_{c} - 0.1::DOUBLE * (q3_{c} - q1_{c}), least(q3_{c} + 0.1::DOUBLE * (q3_{c} - q1_{c}), {c}))") + f" AS {c}" for c in _FC
    )
    + " FROM features, st",
)
def _(spark, d):
    f = S.features(spark, d).select("l_orderkey", "l_linenumber", *_FC)
    out = prep.OutlierBounds("iqr", 0.1, "clip").fit(f, _FC).transform(f)
    return zeroed(out, ["l_orderkey", "l_linenumber"])


@query(
    "empty_outliers_zscore",
    "X-05",
    "WITH st AS (SELECT "
    + ", ".join(f"avg({c}) AS a_{c}, stddev_samp({c}) AS s_{c}" for c in _FC)
    + " FROM features) SELECT l_orderkey, l_linenumber, "
    + ", ".join(
        r(f"CASE WHEN {c} BETWEEN a_{c} - 1.3::DOUBLE * s_{c} AND a_{c} + 1.3::DOUBLE * s_{c} THEN {c} END") + f" AS {c}" for c in _FC
    )
    + " FROM features, st",
)
def _(spark, d):
    f = S.features(spark, d).select("l_orderkey", "l_linenumber", *_FC)
    out = prep.OutlierBounds("zscore", 1.3, "remove").fit(f, _FC).transform(f)
    return zeroed(out, ["l_orderkey", "l_linenumber"])


@query(
    "clip_flagged_rows",
    "X-06",
    "WITH st AS (SELECT "
    + ", ".join(f"quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}" for c in _FC)
    + " FROM features) SELECT l_orderkey, l_linenumber, "
    + ", ".join(r(f"CASE WHEN y = 1 THEN greatest(lo_{c}, least(hi_{c}, {c})) ELSE {c} END") + f" AS {c}" for c in _FC)
    + " FROM features, st",
)
def _(spark, d):
    f = S.features(spark, d).select("l_orderkey", "l_linenumber", "y", *_FC)
    return zeroed(prep.clip_flagged(f, "y", _FC).drop("y"), ["l_orderkey", "l_linenumber"])


@query(
    "quantile_bins",
    "X-07",
    "WITH e AS (SELECT "
    + ", ".join(f"list_sort(list_distinct(quantile_cont({c}, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS e_{c}" for c in _FC)
    + " FROM features) SELECT l_orderkey, l_linenumber, "
    + ", ".join(
        f"CAST(CASE WHEN {c} = e_{c}[1] THEN 0 ELSE (SELECT count(*) - 1 FROM (SELECT unnest(e_{c}) AS x) WHERE x < {c}) END AS INTEGER) AS {c}_bin"
        for c in _FC
    )
    + " FROM features, e",
)
def _(spark, d):
    f = S.features(spark, d).select("l_orderkey", "l_linenumber", *_FC)
    return prep.QuantileBins(5).fit(f, _FC).transform(f).drop(*_FC)


@query(
    "target_encoding",
    "X-09",
    f"""WITH g AS (SELECT avg(CAST(y AS DOUBLE)) AS m FROM categories),
 s AS (SELECT c_mktsegment, (sum(y) + 10 * any_value(m)) / (count(*) + 10) AS e FROM categories, g GROUP BY c_mktsegment)
SELECT o_orderkey, c.c_mktsegment, {r('e')} AS c_mktsegment_encoded FROM categories c JOIN s ON c.c_mktsegment = s.c_mktsegment""",
)
def _(spark, d):
    rows = S.categories(spark, d).select("o_orderkey", "c_mktsegment", "y")
    out = prep.target_encode(rows, "c_mktsegment", "y")
    return out.select("o_orderkey", "c_mktsegment", rnd("c_mktsegment_encoded").alias("c_mktsegment_encoded"))


@query(
    "one_hot_drop_first",
    "X-09",
    """SELECT o_orderkey, CAST(o_orderstatus = 'O' AS INTEGER) AS "status_O", CAST(o_orderstatus = 'P' AS INTEGER) AS "status_P" FROM categories""",
)
def _(spark, d):
    rows = S.categories(spark, d).select("o_orderkey", "o_orderstatus")
    return prep.one_hot(rows, "o_orderstatus", "status", drop_first=True).drop("o_orderstatus")


@query(
    "polynomial_terms",
    "X-10",
    "SELECT l_orderkey, l_linenumber, "
    + ", ".join(
        f'{r(f"{a} * {b}", 4)} AS "{a}^2"' if a == b else f'{r(f"{a} * {b}", 4)} AS "{a} {b}"'
        for i, a in enumerate(_FC)
        for b in _FC[i:]
    )
    + " FROM features",
)
def _(spark, d):
    f = S.features(spark, d).select("l_orderkey", "l_linenumber", *_FC)
    out = prep.polynomial(f, _FC).drop(*_FC)
    keys = ["l_orderkey", "l_linenumber"]
    return out.select(*keys, *[(F.round(F.col(f"`{c}`"), 4) + F.lit(0.0)).alias(c) for c in out.columns if c not in keys])


# ---------------------------------------------------------------- feature scores


@query(
    "mutual_information",
    "L-01",
    "WITH e AS (SELECT "
    + ", ".join(
        f"list_sort(list_distinct(quantile_cont({c}, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS e_{c}, count(DISTINCT {c}) AS d_{c}"
        for c in _FC
    )
    + " FROM features), c AS ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, y, CASE WHEN d_{c} <= 10 THEN CAST({c} AS VARCHAR) WHEN {c} = e_{c}[1] THEN '0'
  ELSE CAST((SELECT count(*) - 1 FROM (SELECT unnest(e_{c}) AS x) WHERE x < {c}) AS VARCHAR) END AS cell FROM features, e"""
        for c in _FC
    )
    + f"""), n AS (SELECT feature, cell, y, CAST(count(*) AS DOUBLE) AS n FROM c GROUP BY ALL),
 t AS (SELECT feature, n / sum(n) OVER f * ln(n * sum(n) OVER f / (sum(n) OVER (PARTITION BY feature, cell) * sum(n) OVER (PARTITION BY feature, y))) AS t
  FROM n WINDOW f AS (PARTITION BY feature))
SELECT feature, {r('sum(t)')} AS score FROM t GROUP BY feature""",
)
def _(spark, d):
    return selection.mutual_information(S.features(spark, d), _FC, "y").withColumn("score", rnd("score"))


def _digamma(x: str) -> str:
    z = f"({x} + 6::DOUBLE)"
    return f"(ln({z}) - 1 / (2 * {z}) - 1 / (12 * {z} * {z}) + 1 / (120 * {z} * {z} * {z} * {z}) - 1 / (252 * {z} * {z} * {z} * {z} * {z} * {z}) - " + " - ".join(f"1 / ({x} + {j}::DOUBLE)" for j in range(6)) + ")"


def _nearest_sql(k: int = 3) -> str:
    """Distances to the k values on either side within the class, then the rows of any class inside that distance."""
    cells = " UNION ALL ".join(f"SELECT '{c}' AS feature, y, {c} AS v, count(*) AS n FROM features GROUP BY ALL" for c in _FC)
    mean = lambda x: f"sum(n * {_digamma(x)}) / sum(n)"
    return f"""WITH c AS ({cells}), p AS (SELECT *, row_number() OVER (PARTITION BY feature, y ORDER BY v) AS at, sum(n) OVER (PARTITION BY feature, y) AS size FROM c),
 d AS (SELECT a.feature, a.y, a.v, abs(b.v - a.v) AS d, sum(b.n - CASE WHEN a.at = b.at THEN 1 ELSE 0 END) AS w FROM p a JOIN p b ON a.feature = b.feature AND a.y = b.y AND b.at BETWEEN a.at - {k} AND a.at + {k} GROUP BY ALL),
 s AS (SELECT *, sum(w) OVER (PARTITION BY feature, y, v ORDER BY d) AS seen FROM d),
 r AS (SELECT p.*, least({k}, size - 1) AS k, (SELECT min(d) FROM s WHERE s.feature = p.feature AND s.y = p.y AND s.v = p.v AND seen >= least({k}, p.size - 1)) AS r FROM p WHERE size > 1),
 t AS (SELECT feature, v, sum(n) AS n FROM r GROUP BY ALL), u AS (SELECT *, sum(n) OVER (PARTITION BY feature ORDER BY v) AS upto FROM t),
 m AS (SELECT r.*, CASE WHEN r > 0 THEN hi.upto - coalesce(lo.upto, 0) ELSE t.n END AS m FROM (SELECT *, v + r AS top, v - r AS bottom FROM r) r
  JOIN t ON t.feature = r.feature AND t.v = r.v
  ASOF LEFT JOIN u hi ON hi.feature = r.feature AND hi.v < r.top ASOF LEFT JOIN u lo ON lo.feature = r.feature AND lo.v <= r.bottom)
SELECT feature, {r(f"greatest(0, {_digamma('sum(n)')} + {mean('k')} - {mean('size')} - {mean('m')})")} AS score FROM m GROUP BY feature"""


@query("nearest_mutual_information", "L-01", _nearest_sql())
def _(spark, d):
    return selection.nearest_mutual_information(S.features(spark, d), _FC, "y").withColumn("score", rnd("score"))


def _anova_sql(exprs):
    return " UNION ALL ".join(
        f"""SELECT '{n}' AS feature, {r('b / (k - 1) / (w / (t - k))', 4)} AS score FROM (SELECT sum(n * (m - g) * (m - g)) AS b, sum(n * v) AS w,
  count(*) AS k, sum(n) AS t FROM (SELECT count({e}) AS n, avg({e}) AS m, var_pop({e}) AS v, any_value(g) AS g FROM features,
  (SELECT avg({e}) AS g FROM features) GROUP BY y))"""
        for n, e in exprs.items()
    )


@query("anova_f_scores", "L-02", _anova_sql({c: c for c in _FC}))
def _(spark, d):
    return selection.anova_f(S.features(spark, d), _FC, "y").withColumn("score", rnd("score", 4))


@query(
    "f_regression_scores",
    "L-02",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {r(f'pow(corr({c}, l_extendedprice), 2) / (1 - pow(corr({c}, l_extendedprice), 2)) * (count(*) - 2)', 4)} AS score FROM features"
        for c in ("l_quantity", "l_discount", "l_tax")
    ),
)
def _(spark, d):
    out = selection.f_regression(S.features(spark, d), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return out.withColumn("score", rnd("score", 4))


@query(
    "chi2_feature_scores",
    "L-03",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, {r('sum((s - n / t * a) * (s - n / t * a) / (n / t * a))', 4)} AS score FROM
 (SELECT CAST(count(*) AS DOUBLE) AS n, sum({c}) AS s FROM features GROUP BY y), (SELECT count(*) AS t, sum({c}) AS a FROM features)"""
        for c in _FC
    ),
)
def _(spark, d):
    return selection.chi2_scores(S.features(spark, d), _FC, "y").withColumn("score", rnd("score", 4))


@query(
    "interaction_scores",
    "L-07",
    "SELECT * FROM ("
    + _anova_sql({f"{a} {b}": f"({a} * {b})" for a, b in combinations(_FC, 2)})
    + ") ORDER BY score DESC, feature LIMIT 20",
)
def _(spark, d):
    return selection.interaction_scores(S.features(spark, d), _FC, "y").withColumn("score", rnd("score", 4))


@query(
    "correlation_pairs",
    "L-08",
    " UNION ALL ".join(
        f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, {r(f'corr({a}, {b})')} AS correlation FROM obs"
        for a, b in combinations(S.OBS_NUMERIC, 2)
    ),
)
def _(spark, d):
    return zeroed(selection.correlations(S.observations(spark, d), S.OBS_NUMERIC), ["feature_1", "feature_2"])


@query(
    "high_correlations",
    "L-08",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, {r(f'corr({a}, {b})')} AS correlation FROM obs"
        for a, b in combinations(S.OBS_NUMERIC, 2)
    )
    + ") WHERE abs(correlation) > 0.5",
)
def _(spark, d):
    return zeroed(
        selection.high_correlations(S.observations(spark, d), S.OBS_NUMERIC, 0.5), ["feature_1", "feature_2"]
    )


def _determinant(cells: list[list[str]]) -> str:
    """SQL of the determinant of a small matrix of expressions, by its first row."""
    if len(cells) == 1:
        return cells[0][0]
    minors = [_determinant([row[:j] + row[j + 1 :] for row in cells[1:]]) for j in range(len(cells))]
    return "(" + " ".join(f"{'-' if j % 2 else '+'} {c} * {m}" for j, (c, m) in enumerate(zip(cells[0], minors, strict=True))) + ")"


def _inflation_sql():
    """Diagonal of the Gram matrix times that of its inverse, by cofactors of the matrix scaled to a unit diagonal."""
    n = len(_FC)
    sums = ", ".join(f"sum({_FC[i]} * {_FC[j]}) AS s{i}{j}" for i in range(n) for j in range(i, n))
    cell = [[f"(s{min(i, j)}{max(i, j)} / sqrt(s{i}{i} * s{j}{j}))" for j in range(n)] for i in range(n)]
    minor = lambda k: _determinant([[cell[i][j] for j in range(n) if j != k] for i in range(n) if i != k])
    return f"WITH g AS (SELECT {sums} FROM features) " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {r(f'{minor(k)} / {_determinant(cell)}', 4)} AS vif FROM g" for k, c in enumerate(_FC)
    )


@query("variance_inflation", "L-09", _inflation_sql())
def _(spark, d):
    return selection.variance_inflation(S.features(spark, d), _FC).withColumn("vif", rnd("vif", 4))
