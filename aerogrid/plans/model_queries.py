"""Classifiers, detectors, reductions and preparation pipelines over whole tables (row checks only)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from aerogrid.functions import timefeat as D
from aerogrid.operators import detectors, metrics, models, quality, reduction, results, stages, windows
from aerogrid.operators.balance import stratified_split, with_class_weight
from aerogrid.plans.oracle_views import r
from aerogrid.plans.registry import query
from aerogrid.session import dealt, scratch_path, settle
from aerogrid.sources import standins as S

_FC = S.FEATURES
_KEY = ["event_id"]
_W = ["temperature_c", "dewpoint_c", "wind_speed_kt", "pressure_hpa"]
# All queries fit with the settings of models.SETTINGS.
FULL = {k: {"kind": k} for k in ("random_forest", "gradient_boosting", "logistic_regression", "neural_network")}
FOREST = FULL["random_forest"]
BOOSTED = FULL["gradient_boosting"]
LOGISTIC = FULL["logistic_regression"]


def poor_conditions(spark, d):
    """Observations with a target that depends on the features: poor flight conditions."""
    y = F.expr("CAST(visibility_m < 3000 OR coalesce(ceiling_ft < 500, false) OR wind_speed_kt > 30 AS INT)")
    return S.observations(spark, d).select("event_id", "station", "ts", *_W, D.hour().alias("hour"), y.alias("y"))


def _settled(spark, d):
    """What models read of the observations, for jobs that read it several times, whatever parts the file is read in."""
    return settle(dealt(poor_conditions(spark, d).select(*_KEY, "y", *_W)))


def _split(spark, d):
    rows = settle(stratified_split(_settled(spark, d), "y", _KEY, [0.15, 0.15], ["train", "val", "test"]))
    return [rows.where(F.col("split") == s) for s in ("train", "val", "test")]


def _fit_and_score(name, ids, settings):
    @query(name, ids)
    def _(spark, d):
        train, _, test = _split(spark, d)
        model = models.fit(with_class_weight(train, "y"), columns=_W, label="y", weight="weight", **settings)
        return models.score(model, test).select("event_id", "y", "score")


_fit_and_score("random_forest_scores", "K-01", FULL["random_forest"])
_fit_and_score("gradient_boosting_scores", "K-02", FULL["gradient_boosting"])
_fit_and_score("logistic_regression_scores", "K-03 B-02", LOGISTIC)


@query("neural_network_scores", "K-04")
def _(spark, d):
    train, _, test = _split(spark, d)
    return models.score(models.fit(train, columns=_W, label="y", **FULL["neural_network"]), test).select("event_id", "y", "score")


@query("forest_importances", "K-01 L-10")
def _(spark, d):
    train, _, _ = _split(spark, d)
    return models.importances(models.fit(train, columns=_W, label="y", **FOREST), _W, spark)


@query("stacked_ensemble", "K-06")
def _(spark, d):
    base = {"forest": FOREST, "linear": LOGISTIC}
    return models.stack(poor_conditions(spark, d), base, _W, "y", _KEY).select("event_id", "y", "score")


@query("cross_validation", "K-16 B-06")
def _(spark, d):
    return models.cross_validate(poor_conditions(spark, d), columns=_W, label="y", keys=_KEY, **FOREST)


@query("train_many_models", "K-17 K-15")
def _(spark, d):
    train, _, test = _split(spark, d)
    runs = {"forest": FOREST, "boosted": BOOSTED, "linear": LOGISTIC}
    return models.train_many(train, test, runs, _W, "y")


@query("packaged_model_scores", "K-19 K-20 K-13")
def _(spark, d):
    train, val, test = _split(spark, d)
    model = models.fit(train, columns=_W, label="y", **FOREST)
    threshold = metrics.best_threshold(models.score(model, val)).first()["threshold"]
    path = scratch_path(spark, "package")
    models.save_package(model, path, _W, threshold, spark)
    return models.score_package(test, path).select("event_id", "y", "score", "prediction")


@query("stored_ensemble_scores", "K-21")
def _(spark, d):
    train, _, test = _split(spark, d)
    rows = []
    for name, kw in {"forest": FOREST, "linear": LOGISTIC}.items():
        path = scratch_path(spark, name)
        models.save_package(models.fit(train, columns=_W, label="y", **kw), path, _W, 0.5, spark)
        rows.append((name, path, None))
    rows.append(("broken", "", "failed to fit"))
    stored = spark.createDataFrame(rows, "model string, path string, error string")
    return models.vote_stored(test, stored).select("event_id", "y", "score")


@query("stored_stack_scores", "K-21 K-06")
def _(spark, d):
    train, val, test = _split(spark, d)
    paths = []
    for name, kw in {"forest": FOREST, "linear": LOGISTIC, "wide": {**FOREST, "maxDepth": 10, "seed": 7}}.items():
        paths.append(scratch_path(spark, name))
        models.save_package(models.fit(train, columns=_W, label="y", **kw), paths[-1], _W, 0.5, spark)
    path = scratch_path(spark, "stack")
    models.save_stack(val, paths, "y", path)
    return models.score_stack(test, path).select("event_id", "y", "score", "prediction")


@query("feature_perturbation", "K-23")
def _(spark, d):
    train, _, test = _split(spark, d)
    model = models.fit(train, columns=_W, label="y", **FOREST)
    return models.perturbation_importance(model, test, _W)


@query("time_step_perturbation", "K-23 W-19")
def _(spark, d):
    length, cols = 4, ["temperature_c", "wind_speed_kt"]
    rows = windows.sequences(poor_conditions(spark, d), cols, "y", length, keep=["event_id"])
    flat = F.flatten("sequence")
    names = [f"s{i}" for i in range(length * len(cols))]
    table = settle(rows.select("event_id", "y", *[flat[i].alias(n) for i, n in enumerate(names)]))
    model = models.fit(table, columns=names, label="y", **LOGISTIC)
    return models.perturbation_importance(model, table, names, steps=length)


@query("grid_search", "H-02")
def _(spark, d):
    space = {"maxDepth": [10, 20], "numTrees": [100, 300]}
    return models.grid_search(poor_conditions(spark, d), "random_forest", _W, "y", _KEY, space, 3)


@query("random_search", "H-03 H-02")
def _(spark, d):
    space = {"maxDepth": [5, 10, 15, 20], "numTrees": [50, 100, 200, 300], "minInstancesPerNode": [1, 2, 4]}
    return models.grid_search(poor_conditions(spark, d), "random_forest", _W, "y", _KEY, space, 3, draws=10)


@query("recursive_elimination", "L-04")
def _(spark, d):
    rows = _settled(spark, d)
    return rows.select("event_id", "y", *models.eliminate_features(rows, _W, "y", 2))


@query("validated_elimination", "L-04")
def _(spark, d):
    rows = _settled(spark, d)
    return rows.select("event_id", "y", *models.eliminate_by_validation(rows, _W, "y", _KEY))


@query("lasso_selection", "L-05")
def _(spark, d):
    rows = _settled(spark, d)
    return rows.select("event_id", "y", *models.lasso_features(rows, _W, "y"))


@query("forest_selection", "L-06")
def _(spark, d):
    rows = _settled(spark, d)
    return rows.select("event_id", "y", *models.important_features(rows, _W, "y"))


# ---------------------------------------------------------------- detectors


@query("isolation_forest", "Q-10")
def _(spark, d):
    obs = S.observations(spark, d).select("event_id", *_W)
    forest = detectors.fit_isolation_forest(obs, _W, "event_id")
    scored = detectors.isolation_scores(obs, _W, forest)
    return detectors.flag_highest(settle(scored), "score", 0.01, "anomaly").select("event_id", "score", "anomaly")


@query("robust_covariance", "Q-11")
def _(spark, d):
    obs = S.observations(spark, d).select("event_id", *_W)
    measured = detectors.robust_distance(obs, _W)
    return detectors.flag_highest(measured, "distance", 0.01, "anomaly").select("event_id", "distance", "anomaly")


@query("local_density", "Q-12")
def _(spark, d):
    obs = S.observations(spark, d).select("event_id", *_W)
    scored = settle(detectors.local_outlier_scores(obs, _W))
    return detectors.flag_highest(scored, "score", 0.01, "anomaly").select("event_id", "score", "anomaly")


@query("detector_ensemble", "Q-13 Q-10 Q-11")
def _(spark, d):
    obs = S.observations(spark, d).select("event_id", *_W)
    forest = detectors.fit_isolation_forest(obs, _W, "event_id")
    both = settle(detectors.robust_distance(detectors.isolation_scores(obs, _W, forest), _W))
    both = detectors.flag_highest(both, "score", 0.01, "isolation_anomaly")
    both = detectors.flag_highest(both, "distance", 0.01, "covariance_anomaly")
    flags = ["isolation_anomaly", "covariance_anomaly"]
    return both.select("event_id", *flags, quality.vote(flags).alias("ensemble_anomaly"))


@query("reconstruction_anomalies", "Q-18")
def _(spark, d):
    obs = S.observations(spark, d).select("event_id", *_W)
    state = reduction.fit_pca(obs, _W, 0.5)
    scored = reduction.reconstruction_error(obs, state)
    return detectors.flag_highest(scored, "error", 0.05, "anomaly").select("event_id", "error", "anomaly")


# ---------------------------------------------------------------- reductions


@query("principal_components", "X-11")
def _(spark, d):
    f = S.features(spark, d).select("l_orderkey", "l_linenumber", *_FC)
    return reduction.project(f, reduction.fit_pca(f, _FC, 0.95))


@query("truncated_svd", "X-12")
def _(spark, d):
    f = S.features(spark, d).select("l_orderkey", "l_linenumber", *_FC)
    return reduction.project(f, reduction.fit_svd(f, _FC, 2), "svd")


@query("nonnegative_factors", "X-13")
def _(spark, d):
    f = S.features(spark, d).select("l_orderkey", "l_linenumber", *_FC)
    return reduction.apply_nmf(f, reduction.fit_nmf(f, _FC, min(30, len(_FC))))


def _synthetic_sql(method: str, digits: int) -> str:
    """The same sums with the numbers that the seed gives."""
    matrix, shifts = reduction.random_matrix(len(_FC), method=method)
    sums = [" + ".join(["0::DOUBLE", *(f"{c} * ({float(w)!r})::DOUBLE" for c, w in zip(_FC, row, strict=True))]) for row in matrix]
    if shifts is not None:
        sums = [f"cos({x} + ({float(b)!r})::DOUBLE) * ({math.sqrt(2.0 / len(matrix))!r})::DOUBLE" for x, b in zip(sums, shifts, strict=True)]
    made = ", ".join(f"{r(x, digits)} AS synthetic_{i}" for i, x in enumerate(sums))
    return f"SELECT l_orderkey, l_linenumber, {made} FROM features"


def _synthetic(name: str, method: str, digits: int):
    @query(name, "X-14", _synthetic_sql(method, digits))
    def _(spark, d):
        rows = S.features(spark, d).select("l_orderkey", "l_linenumber", *_FC)
        out = reduction.random_features(rows, _FC, method=method)
        made = [c for c in out.columns if c.startswith("synthetic_")]
        return out.select("l_orderkey", "l_linenumber", *[(F.round(c, digits) + F.lit(0.0)).alias(c) for c in made])


_synthetic("random_projection", "random_projection", 4)
_synthetic("rbf_features", "rbf", 5)


# ---------------------------------------------------------------- preparation pipelines


@query("preparation_replayed", "X-15")
def _(spark, d):
    f = S.features(spark, d).select("l_orderkey", "l_linenumber", "y", *_FC)
    flow = stages.preparation(_FC, label="y", select="f_score", share=0.5)
    path = scratch_path(spark, "preparation")
    flow.fit(f).write().overwrite().save(path)
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path).transform(f.select("y", *_FC))


@query(
    "prepared_features",
    "X-15 X-01 X-05 X-03",
    "WITH q AS (SELECT "
    + ", ".join(f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in _FC)
    + " FROM features), c AS (SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"greatest(q1_{c} - 0.1::DOUBLE * (q3_{c} - q1_{c}), least(q3_{c} + 0.1::DOUBLE * (q3_{c} - q1_{c}), {c})) AS {c}" for c in _FC)
    + " FROM features, q), s AS (SELECT "
    + ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in _FC)
    + " FROM c) SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"{r(f'({c} - a_{c}) / s_{c}', 5)} AS {c}" for c in _FC)
    + " FROM c, s",
)
def _(spark, d):
    f = S.features(spark, d).select("l_orderkey", "l_linenumber", *_FC)
    _, out = stages.fit_transform(stages.preparation(_FC, outliers="iqr", threshold=0.1), f)
    return out.select("l_orderkey", "l_linenumber", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in _FC])


def _weather_preparation_sql():
    """Clipped at the quartiles, lags and rolling statistics of the clipped values, cycles, then scaled."""
    names = ("temperature_c", "wind_speed_kt")
    clipped = ", ".join(f"greatest(q1_{c} - 1.5::DOUBLE * (q3_{c} - q1_{c}), least(q3_{c} + 1.5::DOUBLE * (q3_{c} - q1_{c}), {c})) AS {c}" for c in names)
    made = {}
    for c in names:
        made |= {f"{c}_lag_{k}": f"lag({c}, {k}) OVER (PARTITION BY station ORDER BY ts, event_id)" for k in stages.WEATHER_LAGS[c]}
        for n in (3, 6, 12, 24):
            for stat, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")):
                made[f"{c}_roll_{stat}_{n}"] = f"CASE WHEN count({c}) OVER w{n} = {n} THEN {f}({c}) OVER w{n} END"
    frames = ", ".join(f"w{n} AS (PARTITION BY station ORDER BY ts, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (3, 6, 12, 24))
    return f"""WITH q AS (SELECT {", ".join(f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in names)} FROM obs),
 p AS (SELECT event_id, station, ts, CAST(visibility_m < 3000 OR coalesce(ceiling_ft < 500, false) OR wind_speed_kt > 30 AS INTEGER) AS y, {clipped}, hour(ts) AS h FROM obs, q),
 s AS (SELECT {", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in names)} FROM p)
SELECT event_id, station, ts, y, {", ".join(f"{r(f'({c} - a_{c}) / s_{c}', 5)} AS {c}" for c in names)}, {", ".join(f"{r(x, 5)} AS {c}" for c, x in made.items())},
 {r("sin(2 * pi() * h / 24)", 5)} AS hour_sin, {r("cos(2 * pi() * h / 24)", 5)} AS hour_cos FROM p, s WINDOW {frames}"""


@query("weather_preparation", "X-16", _weather_preparation_sql())
def _(spark, d):
    rows = poor_conditions(spark, d).select("event_id", "station", "ts", "y", "temperature_c", "wind_speed_kt", "hour")
    out = stages.fit_transform(stages.weather_preparation(rows, "y"), rows)[1]
    return out.withColumns({c: F.round(c, 5) + F.lit(0.0) for c, kind in out.dtypes if kind == "double"})


def _sequence_recipe_sql():
    """Lags and their differences, the eight rolling statistics, and the calendar."""
    names, sizes = ("temperature_c", "wind_speed_kt"), (3, 6, 12)
    series, made = "(PARTITION BY station ORDER BY ts, event_id)", {}
    for c in names:
        for k in (1, 2, 3, 6, 12):
            made[f"{c}_lag_{k}"] = f"lag({c}, {k}) OVER {series}"
            if k > 1:
                made[f"{c}_lag_diff_{k}"] = f"{c} - lag({c}, {k}) OVER {series}"
        for n in sizes:
            full = f"CASE WHEN count({c}) OVER w{n} = {n} THEN {{}} END"
            rolled = {s: f"{f}({c}) OVER w{n}" for s, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))}
            rolled["skew"] = f"CASE WHEN max({c}) OVER w{n} = min({c}) OVER w{n} THEN 0 ELSE list_skewness(list({c}) OVER w{n}) END"
            rolled["kurt"] = f"CASE WHEN max({c}) OVER w{n} = min({c}) OVER w{n} THEN -3 ELSE list_kurtosis(list({c}) OVER w{n}) END" if n > 3 else "CAST(NULL AS DOUBLE)"
            rolled["trend"] = f"{c} - avg({c}) OVER w{n}"
            rolled["zscore"] = f"CASE WHEN stddev_samp({c}) OVER w{n} > 0 THEN ({c} - avg({c}) OVER w{n}) / (stddev_samp({c}) OVER w{n} + 1e-8::DOUBLE) ELSE 0 END"
            made |= {f"{c}_roll_{s}_{n}": full.format(x) for s, x in rolled.items()}
    for name, x, period in (("hour", "hour(ts)", 24), ("day", "(isodow(ts) - 1)", 7), ("month", "month(ts)", 12)):
        made |= {f"{name}_{f}": f"{f}(2 * pi() * {x} / {period})" for f in ("sin", "cos")}
    whole = {
        "hour": "hour(ts)", "day_of_week": "isodow(ts) - 1", "day_of_month": "day(ts)", "day_of_year": "dayofyear(ts)", "week_of_year": "week(ts)",
        "month": "month(ts)", "quarter": "quarter(ts)", "is_weekend": "CAST(isodow(ts) >= 6 AS INTEGER)",
        "is_night": "CAST(hour(ts) >= 22 OR hour(ts) <= 6 AS INTEGER)",
        "is_rush_hour": "CAST(hour(ts) BETWEEN 7 AND 9 OR hour(ts) BETWEEN 17 AND 19 AS INTEGER)",
        "season": "CASE quarter(ts) WHEN 1 THEN 'winter' WHEN 2 THEN 'spring' WHEN 3 THEN 'summer' ELSE 'fall' END",
    }
    frames = ", ".join(f"w{n} AS (PARTITION BY station ORDER BY ts, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in sizes)
    return f"""SELECT event_id, station, ts, CAST(visibility_m < 3000 OR coalesce(ceiling_ft < 500, false) OR wind_speed_kt > 30 AS INTEGER) AS y, {", ".join(names)},
 {", ".join(f'{r(x, 3)} AS "{c}"' for c, x in made.items())}, {", ".join(f'{x} AS "{c}"' for c, x in whole.items())} FROM obs WINDOW {frames}"""


@query("sequence_recipe", "X-17", _sequence_recipe_sql())
def _(spark, d):
    rows = poor_conditions(spark, d).select("event_id", "station", "ts", "y", "temperature_c", "wind_speed_kt")
    out = stages.fit_transform(stages.recipe("lstm", ["temperature_c", "wind_speed_kt"], "y"), rows)[1]
    made = [c for c, kind in out.dtypes if kind == "double" and c not in ("temperature_c", "wind_speed_kt")]
    return out.withColumns({c: F.round(c, 3) + F.lit(0.0) for c in made})


def _linear_recipe_sql():
    main = ("temperature_c", "pressure_hpa", "wind_speed_kt")
    made = {}
    for c in main:
        made |= {f"{c}_pow_2": f"pow({c}, 2)", f"{c}_sqrt": f"sqrt(abs({c}))", f"{c}_log": f"ln(1 + abs({c}))"}
    numbers = [*_W, "hour", "y", *made]
    base = "SELECT event_id, station, ts, " + ", ".join(_W) + """, hour(ts) AS "hour",
 CAST(visibility_m < 3000 OR coalesce(ceiling_ft < 500, false) OR wind_speed_kt > 30 AS INTEGER) AS y FROM obs"""
    rows = {"row_mean": "list_avg(v)", "row_std": "list_stddev_samp(v)", "row_max": "list_max(v)", "row_min": "list_min(v)", "row_range": "list_max(v) - list_min(v)"}
    return f"""WITH p AS ({base}), q AS (SELECT *, {", ".join(f"{x} AS {c}" for c, x in made.items())} FROM p),
 l AS (SELECT *, [{", ".join(f"CAST({c} AS DOUBLE)" for c in numbers)}] AS v FROM q)
SELECT event_id, station, ts, {", ".join(_W)}, "hour", y, {", ".join(f"{r(c, 5)} AS {c}" for c in made)}, {", ".join(f"{r(x, 4)} AS {c}" for c, x in rows.items())} FROM l"""


@query("linear_recipe", "X-17", _linear_recipe_sql())
def _(spark, d):
    out = stages.fit_transform(stages.recipe("logistic_regression", _W, "y"), poor_conditions(spark, d))[1]
    made = {c: 4 if c.startswith("row_") else 5 for c in out.columns if c.startswith("row_") or c.endswith(("_pow_2", "_sqrt", "_log"))}
    return out.withColumns({c: F.round(c, digits) + F.lit(0.0) for c, digits in made.items()})


@query("engineered_features", "X-18")
def _(spark, d):
    rows = settle(poor_conditions(spark, d).select("event_id", "station", "ts", "y", "temperature_c", "pressure_hpa"))
    return stages.fit_transform(stages.engineered(["temperature_c"], "y", 10, "f_classif"), rows)[1]


@query("evaluated_models_ranked", "H-07 W-18")
def _(spark, d):
    train, _, test = _split(spark, d)
    table = models.train_many(train, test, {"forest": FOREST, "linear": LOGISTIC}, _W, "y")
    return results.rank_models(table.withColumn("experiment", F.lit("balanced")), ["experiment"], "f1", "model")
