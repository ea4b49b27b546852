"""Balancing, splitting, and evaluation of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerogrid.functions.num import rnd
from aerogrid.operators import balance, metrics
from aerogrid.plans.join_queries import windowed
from aerogrid.plans.oracle_views import r
from aerogrid.plans.registry import query
from aerogrid.plans.window_queries import zeroed
from aerogrid.session import settle
from aerogrid.sources import standins as S

# ---------------------------------------------------------------- balancing and splitting

_STRATA = """s AS (SELECT *, CASE WHEN has_regulation = 1 THEN 'positive' WHEN in_window = 1 THEN 'window' ELSE 'outside' END AS stratum FROM windowed)"""


@query(
    "balance_by_windows",
    "B-01",
    f"""WITH {_STRATA}, n AS (SELECT count(*) FILTER (stratum = 'positive') AS p, count(*) FILTER (stratum = 'window') AS w FROM s),
 k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(event_id || '|42'), event_id) AS rn FROM s)
SELECT event_id, station, ts, has_regulation, in_window, stratum FROM k, n
WHERE stratum = 'positive' OR (stratum = 'window' AND rn <= least(w, CAST(floor(p * 0.7::DOUBLE) AS BIGINT)))
 OR (stratum = 'outside' AND rn <= p - least(w, CAST(floor(p * 0.7::DOUBLE) AS BIGINT)))""",
)
def _(spark, d):
    rows = settle(windowed(spark, d).select("event_id", "station", "ts", "has_regulation", "in_window"))
    return balance.balance_windows(rows, "has_regulation", "in_window", ["event_id"])


@query(
    "class_weights",
    "B-02",
    f"""WITH c AS (SELECT y, count(*) AS n FROM features GROUP BY y)
SELECT y, n, {r('(SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * CAST(n AS DOUBLE))')} AS weight FROM c""",
)
def _(spark, d):
    return balance.class_weights(S.features(spark, d), "y").withColumn("weight", rnd("weight"))


@query(
    "chronological_split",
    "B-04",
    """WITH n AS (SELECT CAST(floor(count(*) * 0.85::DOUBLE) AS BIGINT) AS b FROM obs),
 k AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS p FROM obs)
SELECT event_id, ts, CASE WHEN p < CAST(floor(b * 0.82::DOUBLE) AS BIGINT) THEN 'train' WHEN p < b THEN 'val' ELSE 'test' END AS split FROM k, n""",
)
def _(spark, d):
    obs = S.observations(spark, d).select("event_id", "ts")
    return balance.chronological_split(obs, [0.85, 0.82], ["train", "val", "test"])


@query(
    "stratified_split",
    "B-05",
    """WITH k AS (SELECT o_orderkey, y, row_number() OVER (PARTITION BY y ORDER BY md5(o_orderkey || '|42'), o_orderkey) AS rn,
  count(*) OVER (PARTITION BY y) AS n FROM categories)
SELECT o_orderkey, y, CASE WHEN rn <= CAST(round(n * 0.15::DOUBLE) AS BIGINT) THEN 'val'
 WHEN rn <= CAST(round(n * 0.15::DOUBLE) AS BIGINT) + CAST(round(n * 0.15::DOUBLE) AS BIGINT) THEN 'test' ELSE 'train' END AS split FROM k""",
)
def _(spark, d):
    rows = S.categories(spark, d).select("o_orderkey", "y")
    return balance.stratified_split(rows, "y", ["o_orderkey"], [0.15, 0.15], ["train", "val", "test"])


@query(
    "stratified_folds",
    "B-06",
    """SELECT o_orderkey, y, CAST((row_number() OVER (PARTITION BY y ORDER BY md5(o_orderkey || '|42'), o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM categories""",
)
def _(spark, d):
    return balance.stratified_folds(S.categories(spark, d).select("o_orderkey", "y"), "y", ["o_orderkey"])


# ---------------------------------------------------------------- votes

_P = ["least(1, l_discount * 10)", "l_quantity / 50", "least(1, l_tax * 12)"]
_W = [2.0, 1.0, 1.0]


def _scores():
    return [
        F.least(F.lit(1.0), F.col("l_discount") * 10.0),
        F.col("l_quantity") / 50.0,
        F.least(F.lit(1.0), F.col("l_tax") * 12.0),
    ]


_SOFT = "((" + " + ".join(f"{p} * {w}::DOUBLE" for p, w in zip(_P, _W)) + ") / 4::DOUBLE)"
_HARD = "CAST(" + " + ".join(f"CAST({p} >= 0.5::DOUBLE AS INTEGER) * {w}::DOUBLE" for p, w in zip(_P, _W)) + " > 2 AS INTEGER)"


@query(
    "weighted_votes",
    "K-05",
    f"SELECT l_orderkey, l_linenumber, {r(_SOFT)} AS soft, {_HARD} AS hard FROM features",
)
def _(spark, d):
    scores = _scores()
    votes = [(s >= 0.5).cast("int") for s in scores]
    return S.features(spark, d).select(
        "l_orderkey",
        "l_linenumber",
        (rnd(metrics.soft_vote(scores, _W)) + F.lit(0.0)).alias("soft"),
        metrics.hard_vote(votes, _W).alias("hard"),
    )


@query(
    "base_models_and_ensemble",
    "K-18",
    " UNION ALL ".join(
        f"SELECT '{n}' AS model, {r(f'avg(CAST(y = CAST({p} >= 0.5::DOUBLE AS INTEGER) AS DOUBLE))')} AS accuracy FROM features"
        for n, p in zip(("a", "b", "c"), _P)
    )
    + f" UNION ALL SELECT 'ensemble', {r(f'avg(CAST(y = {_HARD} AS DOUBLE))')} FROM features",
)
def _(spark, d):
    votes = [(s >= 0.5).cast("int") for s in _scores()]
    named = dict(zip(("a", "b", "c"), votes)) | {"ensemble": metrics.hard_vote(votes, _W)}
    return metrics.model_accuracy(S.features(spark, d), "y", named).withColumn("accuracy", rnd("accuracy"))


# ---------------------------------------------------------------- confusion and rates


@query(
    "confusion_matrix",
    "K-07",
    f"""SELECT y, yhat, count(*) AS n, {r('count(*) / CAST(sum(count(*)) OVER (PARTITION BY y) AS DOUBLE)')} AS share FROM graded GROUP BY y, yhat""",
)
def _(spark, d):
    return metrics.confusion(S.graded(spark, d), normalise=True).withColumn("share", rnd("share"))


@query(
    "confusion_matrix_wide",
    "K-07",
    'SELECT y, count(*) FILTER (yhat = 0) AS "0", count(*) FILTER (yhat = 1) AS "1" FROM graded GROUP BY y',
)
def _(spark, d):
    return metrics.confusion_wide(S.graded(spark, d), [0, 1])


_CELLS = """c AS (SELECT count(*) FILTER (y = 1 AND yhat = 1) AS tp, count(*) FILTER (y = 0 AND yhat = 1) AS fp,
 count(*) FILTER (y = 1 AND yhat = 0) AS fn, count(*) FILTER (y = 0 AND yhat = 0) AS tn FROM graded)"""


@query(
    "binary_metrics",
    "K-08",
    f"""WITH {_CELLS} SELECT {r('(tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE)')} AS accuracy,
 {r('coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0)')} AS "precision", {r('coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0)')} AS recall,
 {r('coalesce(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0)')} AS f1 FROM c""",
)
def _(spark, d):
    return zeroed(metrics.binary_metrics(S.graded(spark, d)), [])


_REPORT = """k AS (SELECT k.c AS cls, count(*) FILTER (y = k.c AND yhat = k.c) AS h, count(*) FILTER (y = k.c) AS s,
 count(*) FILTER (yhat = k.c) AS g FROM graded, (SELECT unnest([0, 1]) AS c) k GROUP BY k.c),
 p AS (SELECT cls, s, coalesce(h / CAST(nullif(g, 0) AS DOUBLE), 0) AS p, coalesce(h / CAST(nullif(s, 0) AS DOUBLE), 0) AS r FROM k),
 f AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f FROM p)"""


@query(
    "weighted_metrics",
    "K-09",
    f"""WITH {_REPORT} SELECT {r('sum(r * s) / sum(s)')} AS accuracy, {r('sum(p * s) / sum(s)')} AS "precision", {r('sum(r * s) / sum(s)')} AS recall,
 {r('sum(f * s) / sum(s)')} AS f1 FROM f""",
)
def _(spark, d):
    return zeroed(metrics.weighted_metrics(S.graded(spark, d)), [])


@query(
    "class_report",
    "K-14",
    f'WITH {_REPORT} SELECT cls AS class, {r("p")} AS "precision", {r("r")} AS recall, {r("f")} AS f1, s AS support FROM f',
)
def _(spark, d):
    return zeroed(metrics.class_report(S.graded(spark, d)), ["class", "support"])


@query(
    "negative_class_rates",
    "K-10",
    f"WITH {_CELLS} SELECT {r('tn / CAST(tn + fp AS DOUBLE)')} AS class0_recall, {r('tn / CAST(tn + fn AS DOUBLE)')} AS class0_precision FROM c",
)
def _(spark, d):
    return zeroed(metrics.negative_class_rates(S.graded(spark, d)), [])


# ---------------------------------------------------------------- curves and thresholds

_CURVE = """v AS (SELECT model, score, CAST(sum(y) AS DOUBLE) AS tp, CAST(sum(1 - y) AS DOUBLE) AS fp FROM scored GROUP BY model, score),
 q AS (SELECT *, sum(tp) OVER w AS tc, sum(fp) OVER w AS fc, sum(tp) OVER (PARTITION BY model) AS tt, sum(fp) OVER (PARTITION BY model) AS ft FROM v
  WINDOW w AS (PARTITION BY model ORDER BY score DESC))"""


@query(
    "roc_points",
    "K-11",
    f"WITH {_CURVE} SELECT model, {r('score')} AS threshold, {r('fc / ft')} AS fpr, {r('tc / tt')} AS tpr FROM q",
)
def _(spark, d):
    return zeroed(metrics.roc_points(S.scored(spark, d), by=["model"]), ["model"])


@query(
    "roc_auc",
    "K-11",
    f"""WITH k AS (SELECT model, y, score, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0::DOUBLE AS rk FROM scored)
SELECT model, {r('(sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) / (CAST(count(*) FILTER (y = 1) AS DOUBLE) * count(*) FILTER (y = 0))')} AS auc
FROM k GROUP BY model""",
)
def _(spark, d):
    return metrics.roc_auc(S.scored(spark, d), by=["model"]).withColumn("auc", rnd("auc"))


@query(
    "precision_recall_points",
    "K-12",
    f"""WITH {_CURVE} SELECT model, {r('score')} AS threshold, {r('tc / (tc + fc)')} AS "precision", {r('tc / tt')} AS recall FROM q""",
)
def _(spark, d):
    return zeroed(metrics.pr_points(S.scored(spark, d), by=["model"]), ["model"])


_TH = """t AS (SELECT CAST(i AS DOUBLE) / 20 AS t FROM (SELECT unnest(generate_series(2, 17)) AS i)),
 m AS (SELECT model, t, CAST(count(*) FILTER (score >= t AND y = 1) AS DOUBLE) AS tp, count(*) FILTER (score >= t AND y = 0) AS fp,
  count(*) FILTER (y = 1) AS p FROM scored, t GROUP BY model, t),
 x AS (SELECT model, t, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS pr, CASE WHEN p = 0 THEN 0 ELSE tp / p END AS re FROM m),
 f AS (SELECT *, CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END AS f1 FROM x)"""


@query(
    "threshold_table",
    "K-13",
    f"""WITH {_TH} SELECT model, t AS threshold, {r('pr')} AS "precision", {r('re')} AS recall, {r('f1')} AS f1 FROM f""",
)
def _(spark, d):
    return zeroed(metrics.threshold_table(S.scored(spark, d), by=["model"]), ["model", "threshold"])


@query(
    "best_threshold",
    "K-13",
    f"""WITH {_TH}, b AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, t) AS rn FROM f)
SELECT model, t AS threshold, {r('f1')} AS f1 FROM b WHERE rn = 1""",
)
def _(spark, d):
    return metrics.best_threshold(S.scored(spark, d), by=["model"]).withColumn("f1", rnd("f1"))


@query(
    "model_comparison",
    "K-15",
    f"""WITH {_TH}, b AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, t) AS rn FROM f)
SELECT model AS best_model, {r('f1')} AS best_f1 FROM b WHERE rn = 1 ORDER BY f1 DESC, model LIMIT 1""",
)
def _(spark, d):
    table = metrics.best_threshold(S.scored(spark, d), by=["model"])
    top = table.agg(F.max_by(F.struct("model", "f1"), "f1").alias("b"))
    return top.select(F.col("b.model").alias("best_model"), rnd("b.f1").alias("best_f1"))


@query(
    "confidence_summary",
    "K-22",
    f"""WITH c AS (SELECT greatest({_SOFT}, 1 - {_SOFT}) AS c, CAST({_SOFT} >= 0.5::DOUBLE AS INTEGER) = y AS correct FROM features)
SELECT correct, count(*) AS n, {r('avg(c)')} AS mean_confidence, {r('avg(CAST(c > 0.9::DOUBLE AS DOUBLE))')} AS high_share,
 {r('avg(CAST(c < 0.6::DOUBLE AS DOUBLE))')} AS low_share FROM c GROUP BY correct""",
)
def _(spark, d):
    p = metrics.soft_vote(_scores(), _W)
    rows = S.features(spark, d).select("y", p.alias("p"))
    c, correct = F.greatest(F.col("p"), 1.0 - F.col("p")), (F.col("p") >= 0.5).cast("int") == F.col("y")
    return zeroed(metrics.confidence_summary(rows, c, correct), ["correct", "n"])
