"""Stored results and tuning trials."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerogrid.functions.num import rnd
from aerogrid.operators import metrics, results
from aerogrid.plans.oracle_views import r
from aerogrid.plans.registry import query
from aerogrid.plans.window_queries import zeroed
from aerogrid.sources import standins as S

_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]



@query(
    "list_successful_results",
    "S-13",
    "SELECT trial_id, model, experiment, stored_on FROM trials WHERE error IS NULL AND experiment = 'ECONOMY' ORDER BY stored_on DESC, trial_id",
)
def _(spark, d):
    keep = F.col("error").isNull() & (F.col("experiment") == "ECONOMY")
    out = results.newest_first(S.trials(spark, d), "stored_on", keep, "trial_id")
    return out.select("trial_id", "model", "experiment", "stored_on")


@query(
    "results_past_retention",
    "S-14",
    "SELECT trial_id, stored_on FROM trials WHERE stored_on < DATE '2024-03-30' - 30",
)
def _(spark, d):
    _, removed = results.split_retention(S.trials(spark, d), "stored_on", "2024-03-30", 30)
    return removed.select("trial_id", "stored_on")


@query(
    "suite_results_by_f1",
    "S-15",
    f"SELECT trial_id, model, {r('f1')} AS f1 FROM trials ORDER BY f1 DESC NULLS LAST, trial_id",
)
def _(spark, d):
    out = results.with_status(S.trials(spark, d), "error", "f1", "trial_id")
    return out.select("trial_id", "model", rnd("f1").alias("f1"))


@query(
    "model_by_experiment",
    "A-15",
    "SELECT model, "
    + ", ".join(r(f"avg(score) FILTER (experiment = '{t}')") + f' AS "{t}"' for t in _TYPES)
    + " FROM trials GROUP BY model",
)
def _(spark, d):
    out = results.compare(S.trials(spark, d), "model", "experiment", "score", _TYPES)
    return zeroed(out, ["model"])


@query(
    "experiment_rollup",
    "A-16",
    f"""SELECT experiment, arg_max(model, (score, model)) AS best_model, {r('max(score)')} AS best_score, {r('avg(score)')} AS mean_score, sum(time_s) AS total_time
FROM trials WHERE score IS NOT NULL GROUP BY experiment""".replace(
        "sum(time_s) AS total_time\nFROM trials WHERE score IS NOT NULL GROUP BY experiment",
        "(SELECT sum(time_s) FROM trials u WHERE u.experiment = t.experiment) AS total_time\nFROM trials t WHERE score IS NOT NULL GROUP BY experiment",
    ),
)
def _(spark, d):
    out = results.experiment_rollup(S.trials(spark, d), "experiment", "model", "score", "time_s")
    return out.withColumns({c: rnd(c) for c in ("best_score", "mean_score")})


@query(
    "cross_validation_rollup",
    "A-17",
    f"""WITH c AS (SELECT doc_id % 5 AS fold, count(*) FILTER (y = 1 AND yhat = 1) AS tp, count(*) FILTER (y = 0 AND yhat = 1) AS fp,
  count(*) FILTER (y = 1 AND yhat = 0) AS fn, count(*) FILTER (y = 0 AND yhat = 0) AS tn, count(*) AS n FROM graded GROUP BY fold),
 m AS (SELECT *, (tp + tn) / CAST(n AS DOUBLE) AS a, coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0) AS p FROM c)
SELECT {r('avg(a)')} AS accuracy_mean, {r('stddev_pop(a)')} AS accuracy_std, {r('avg(p)')} AS precision_mean, {r('stddev_pop(p)')} AS precision_std,
 CAST(sum(n) AS DOUBLE) AS total_time, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tn) AS BIGINT) AS tn FROM m""",
)
def _(spark, d):
    graded = S.graded(spark, d).withColumn("fold", F.col("doc_id") % 5)
    a, p = F.col("y"), F.col("yhat")
    cells = graded.groupBy("fold").agg(
        F.count_if((a == 1) & (p == 1)).alias("tp"),
        F.count_if((a == 0) & (p == 1)).alias("fp"),
        F.count_if((a == 1) & (p == 0)).alias("fn"),
        F.count_if((a == 0) & (p == 0)).alias("tn"),
        F.count(F.lit(1)).cast("double").alias("time_s"),
    )
    scores = metrics.binary_metrics(graded, by=["fold"]).select("fold", "accuracy", "precision")
    out = results.fold_rollup(cells.join(scores, "fold"), ["accuracy", "precision"], "time_s", ["tp", "fp", "fn", "tn"])
    return out.withColumns({c: rnd(c) for c in out.columns if c.endswith(("_mean", "_std"))})


@query(
    "suite_summary",
    "A-18",
    " UNION ALL ".join(
        f"SELECT '{m}' AS metric, {r(f'max({m})')} AS best, {r(f'avg({m})')} AS mean, {r(f'stddev_samp({m})')} AS std, "
        f"(SELECT trial_id FROM trials WHERE {m} IS NOT NULL ORDER BY {m} DESC, trial_id LIMIT 1) AS best_row FROM trials"
        for m in ("score", "f1")
    ),
)
def _(spark, d):
    out = results.suite_summary(S.trials(spark, d), "trial_id", ["score", "f1"])
    return out.withColumns({c: rnd(c) for c in ("best", "mean", "std")})


@query(
    "metrics_long_form",
    "A-19",
    f"""SELECT trial_id, model, 'score' AS metric, {r('score')} AS "value" FROM trials
UNION ALL SELECT trial_id, model, 'f1', {r('f1')} FROM trials UNION ALL SELECT trial_id, model, 'time_s', time_s FROM trials""",
)
def _(spark, d):
    out = results.long_metrics(S.trials(spark, d), ["trial_id", "model"], ["score", "f1", "time_s"])
    return out.withColumn("value", rnd("value") + F.lit(0.0))


@query(
    "learning_curve_spread",
    "A-20",
    f"SELECT time_s, {r('avg(score)')} AS mean, {r('stddev_pop(score)')} AS std FROM trials GROUP BY time_s",
)
def _(spark, d):
    return zeroed(results.spread_by(S.trials(spark, d), "time_s", "score"), ["time_s"])


_MEANS = "m AS (SELECT experiment, model, avg(score) AS score FROM trials GROUP BY experiment, model)"


@query(
    "rank_models",
    "W-18",
    f"""WITH {_MEANS} SELECT experiment, model, {r('score')} AS score,
 CAST(row_number() OVER (PARTITION BY experiment ORDER BY score DESC NULLS LAST, model) AS INTEGER) AS rank FROM m""",
)
def _(spark, d):
    means = S.trials(spark, d).groupBy("experiment", "model").agg(F.avg("score").alias("score"))
    return results.rank_models(means, ["experiment"], "score", "model").withColumn("score", rnd("score"))


@query(
    "rank_all_trials",
    "W-18",
    f"SELECT trial_id, experiment, {r('f1')} AS f1, CASE WHEN f1 IS NOT NULL THEN rank() OVER (PARTITION BY experiment ORDER BY f1 DESC NULLS LAST) END AS rank FROM trials",
)
def _(spark, d):
    out = results.rank_scores(S.trials(spark, d).select("trial_id", "experiment", "f1"), ["experiment"], "f1")
    return out.select("trial_id", "experiment", rnd("f1").alias("f1"), "rank")


@query(
    "best_models",
    "O-03",
    f"SELECT trial_id, model, {r('score')} AS score FROM trials WHERE score IS NOT NULL ORDER BY score DESC, trial_id LIMIT 10",
)
def _(spark, d):
    out = results.best_rows(S.trials(spark, d), "score", 10, "trial_id")
    return out.select("trial_id", "model", rnd("score").alias("score"))


@query(
    "top_trials_per_model",
    "O-04",
    f"""SELECT model, trial_id, {r('score')} AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY model
 ORDER BY score DESC NULLS LAST, trial_id) AS rank FROM trials) WHERE rank <= 10""",
)
def _(spark, d):
    out = results.top_per_group(S.trials(spark, d), "model", "score", 10, "trial_id")
    return out.select("model", "trial_id", rnd("score").alias("score"), "rank")


@query(
    "top_five_by_f1",
    "O-06",
    f"SELECT trial_id, model, {r('f1')} AS f1 FROM trials WHERE f1 IS NOT NULL ORDER BY f1 DESC, trial_id LIMIT 5",
)
def _(spark, d):
    out = results.best_rows(S.trials(spark, d), "f1", 5, "trial_id")
    return out.select("trial_id", "model", rnd("f1").alias("f1"))


@query(
    "parameter_grid",
    "H-01",
    """SELECT trial_id, depth, rate FROM trials, (SELECT unnest([3, 5, 8]) AS depth), (SELECT unnest([0.05::DOUBLE, 0.1::DOUBLE]) AS rate)""",
)
def _(spark, d):
    base = S.trials(spark, d).select("trial_id")
    return results.grid_over(base, {"depth": [3, 5, 8], "rate": [0.05, 0.1]})


@query(
    "random_trials",
    "H-03",
    "SELECT trial_id, model FROM trials ORDER BY md5(trial_id || '|42'), trial_id LIMIT 20",
)
def _(spark, d):
    return results.sample_trials(S.trials(spark, d).select("trial_id", "model"), "trial_id", 20)


@query(
    "best_so_far",
    "H-04",
    f"""SELECT experiment, trial_id, {r('f1')} AS f1, {r('max(f1) OVER (PARTITION BY experiment ORDER BY trial_id)')} AS best_so_far FROM trials""",
)
def _(spark, d):
    out = results.best_so_far(S.trials(spark, d), ["experiment"], "trial_id", "f1")
    return zeroed(out, ["experiment", "trial_id"])


@query(
    "pareto_front",
    "H-05",
    f"""WITH k AS (SELECT trial_id, f1, -time_s AS speed FROM trials WHERE f1 IS NOT NULL),
 p AS (SELECT * FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.f1 >= a.f1 AND b.speed >= a.speed AND (b.f1 > a.f1 OR b.speed > a.speed)))
SELECT trial_id, {r('f1')} AS f1, speed, f1 = (SELECT max(f1) FROM p) AS primary_pick FROM p""",
)
def _(spark, d):
    rows = S.trials(spark, d).select("trial_id", "f1", (-F.col("time_s")).alias("speed"))
    out = results.pareto_front(rows, "trial_id", "f1", "speed")
    return out.withColumn("f1", rnd("f1"))


@query(
    "trial_status",
    "H-07",
    f"""SELECT trial_id, CASE WHEN error IS NULL THEN 'success' ELSE 'failed' END AS status, {r('score')} AS score FROM trials
ORDER BY score DESC NULLS LAST, trial_id""",
)
def _(spark, d):
    out = results.with_status(S.trials(spark, d), "error", "score", "trial_id")
    return out.select("trial_id", "status", rnd("score").alias("score"))
