"""Data quality, drift and descriptive summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerogrid.functions.num import rnd
from aerogrid.functions.text import cause_class
from aerogrid.operators import drift, filters, quality, summaries
from aerogrid.plans.oracle_views import r
from aerogrid.plans.registry import query
from aerogrid.plans.window_queries import zeroed
from aerogrid.sources import standins as S

RULES = {
    "temperature_c": {"min": -5, "max": 25, "not_null": True},
    "wind_speed_kt": {"min": 0, "max": 40},
    "ceiling_ft": {"min": 100, "not_null": True},
    "station": {"values": ["EGLL", "LSZH", "LFPG"]},
}
TYPES = {"ts": "datetime", "station": "object", "temperature_c": "float", "event_id": "object"}


def _names(df, mapping):
    return df.select(*[F.col(v).alias(k) for k, v in mapping.items()])


_WEATHER_NAMES = {
    "temperature": "temperature_c",
    "dewpoint": "dewpoint_c",
    "pressure": "pressure_hpa",
    "wind_speed": "wind_speed_kt",
    "wind_direction": "wind_direction",
    "visibility": "visibility_m",
    "ceiling": "ceiling_ft",
}


_SCHEMA_SQL = """SELECT 'required' AS "check", 'cloud_cover' AS "column", 'error' AS severity, CAST(1 AS BIGINT) AS n
UNION ALL SELECT 'type', 'event_id', 'warning', CAST(max(CASE WHEN typeof(event_id) <> 'VARCHAR' THEN 1 ELSE 0 END) AS BIGINT) FROM obs"""


@query("schema_check", "Q-01 U-04", _SCHEMA_SQL)
def _(spark, d):
    required = ["event_id", "ts", "station", "temperature_c", "cloud_cover"]
    return quality.check_schema(S.observations(spark, d), required, TYPES)


@query(
    "constraint_check",
    "Q-02",
    """WITH c AS (SELECT count(*) FILTER (temperature_c < -5) a, count(*) FILTER (temperature_c > 25) b, count(*) FILTER (temperature_c IS NULL) c_,
  count(*) FILTER (wind_speed_kt < 0) d_, count(*) FILTER (wind_speed_kt > 40) e, count(*) FILTER (ceiling_ft < 100) f,
  count(*) FILTER (ceiling_ft IS NULL) g, count(*) FILTER (NOT coalesce(station IN ('EGLL', 'LSZH', 'LFPG'), false)) h FROM obs)
SELECT 'below_min' AS "check", 'temperature_c' AS "column", 'warning' AS severity, a AS n FROM c
UNION ALL SELECT 'above_max', 'temperature_c', 'warning', b FROM c UNION ALL SELECT 'null', 'temperature_c', 'error', c_ FROM c
UNION ALL SELECT 'below_min', 'wind_speed_kt', 'warning', d_ FROM c UNION ALL SELECT 'above_max', 'wind_speed_kt', 'warning', e FROM c
UNION ALL SELECT 'below_min', 'ceiling_ft', 'warning', f FROM c UNION ALL SELECT 'null', 'ceiling_ft', 'error', g FROM c
UNION ALL SELECT 'not_allowed', 'station', 'warning', h FROM c""",
)
def _(spark, d):
    return quality.check_constraints(S.observations(spark, d), RULES)


@query(
    "invalid_value_examples",
    "O-07",
    "SELECT DISTINCT reason FROM intervals WHERE NOT coalesce(reason IN ('W - Weather', 'Strong WIND'), false) ORDER BY reason NULLS LAST LIMIT 5",
)
def _(spark, d):
    return quality.invalid_values(S.intervals(spark, d), "reason", ["W - Weather", "Strong WIND"])


@query(
    "derive_rules",
    "Q-03",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{t}' AS type, CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value, "
        f"count({c}) = count(*) AS not_null FROM obs"
        for c, t in [("event_id", "bigint"), *[(c, "double") for c in S.OBS_NUMERIC]]
    ),
)
def _(spark, d):
    return quality.derive_rules(S.observations(spark, d))


@query(
    "weather_rule_pack",
    "Q-04",
    " UNION ALL ".join(
        f"SELECT '{n}' AS \"check\", '{c}' AS \"column\", 'warning' AS severity, count(*) FILTER ({_WEATHER_NAMES[c]} {op} {rule[k]}) AS n FROM obs"
        for c, rule in quality.WEATHER_RULES.items()
        for n, k, op in (("below_min", "min", "<"), ("above_max", "max", ">"))
    ),
)
def _(spark, d):
    return quality.check_constraints(_names(S.observations(spark, d), _WEATHER_NAMES), quality.WEATHER_RULES)


@query(
    "exact_duplicates",
    "Q-05",
    f"""WITH g AS (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT CAST(sum(c) AS BIGINT) AS "rows", CAST(sum(c - 1) AS BIGINT) AS duplicates, {r('sum(c - 1) / sum(c)')} AS ratio FROM g""",
)
def _(spark, d):
    out = quality.duplicates(S.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])
    return out.withColumn("ratio", rnd("ratio"))


@query(
    "duplicate_observations",
    "Q-05",
    f"""WITH u AS (SELECT station, hour(ts) AS h, temperature_c, wind_speed_kt FROM obs),
 g AS (SELECT count(*) AS c FROM u GROUP BY station, h, temperature_c, wind_speed_kt)
SELECT CAST(sum(c) AS BIGINT) AS "rows", CAST(sum(c - 1) AS BIGINT) AS duplicates, {r('sum(c - 1) / sum(c)')} AS ratio FROM g""",
)
def _(spark, d):
    obs = S.observations(spark, d).select("station", F.hour("ts").alias("h"), "temperature_c", "wind_speed_kt")
    return quality.duplicates(obs).withColumn("ratio", rnd("ratio"))


@query(
    "consistency_check",
    "Q-06",
    """SELECT 'temperature_below_dewpoint' AS "check", 'temperature_c' AS "column", 'warning' AS severity,
 count(*) FILTER (temperature_c < dewpoint_c) AS n FROM obs
UNION ALL SELECT 'gust_below_wind', 'wind_gust_kt', 'warning', count(*) FILTER (wind_gust_kt < wind_speed_kt) FROM obs""",
)
def _(spark, d):
    return quality.consistency(S.observations(spark, d), "temperature_c", "dewpoint_c", "wind_speed_kt", "wind_gust_kt")


@query(
    "zscore_anomalies",
    "Q-07",
    " UNION ALL ".join(
        f"SELECT 'zscore' AS \"check\", '{c}' AS \"column\", 'warning' AS severity, count(*) FILTER (abs(({c} - m) / s) > 1.5) AS n "
        f"FROM obs, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM obs)"
        for c in S.OBS_NUMERIC
    ),
)
def _(spark, d):
    return quality.zscore_counts(S.observations(spark, d), S.OBS_NUMERIC, 1.5)


def _report_sql():
    """One row per check; the columns' own checks are built from their names."""
    obs = ["temperature_c", "dewpoint_c", "wind_speed_kt", "wind_direction", "wind_gust_kt", "visibility_m", "ceiling_ft", "pressure_hpa"]
    every = ["event_id", "ts", "station", *obs]
    span = "(CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / 1800000000::DOUBLE)"
    rows = [
        ("type", "event_id", "warning", "max(CASE WHEN typeof(event_id) <> 'VARCHAR' THEN 1 ELSE 0 END)", "obs"),
        ("below_min", "temperature_c", "warning", "count(*) FILTER (temperature_c < -5)", "obs"),
        ("above_max", "temperature_c", "warning", "count(*) FILTER (temperature_c > 25)", "obs"),
        ("null", "temperature_c", "error", "count(*) - count(temperature_c)", "obs"),
        ("below_min", "wind_speed_kt", "warning", "count(*) FILTER (wind_speed_kt < 0)", "obs"),
        ("above_max", "wind_speed_kt", "warning", "count(*) FILTER (wind_speed_kt > 40)", "obs"),
        ("below_min", "ceiling_ft", "warning", "count(*) FILTER (ceiling_ft < 100)", "obs"),
        ("null", "ceiling_ft", "error", "count(*) - count(ceiling_ft)", "obs"),
        ("not_allowed", "station", "warning", "count(*) FILTER (NOT coalesce(station IN ('EGLL', 'LSZH', 'LFPG'), false))", "obs"),
        *[("zscore", c, "warning", f"count(*) FILTER (abs(({c} - m) / nullif(s, 0)) > 3)", f"obs, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM obs)") for c in obs],
        ("temperature_below_dewpoint", "temperature_c", "warning", "count(*) FILTER (temperature_c < dewpoint_c)", "obs"),
        ("gust_below_wind", "wind_gust_kt", "warning", "count(*) FILTER (wind_gust_kt < wind_speed_kt)", "obs"),
        ("duplicate_key", "station,ts", "error", "count(*) - count(DISTINCT (station, ts))", "obs"),
        ("duplicate_row", "(all)", "warning", "CASE WHEN count(*) - count(DISTINCT event_id) > 0.1 * count(*) THEN count(*) - count(DISTINCT event_id) ELSE 0 END", "obs"),
        *[("mostly_missing", c, "warning", f"CASE WHEN count(*) - count({c}) > 0.5 * count(*) THEN count(*) - count({c}) ELSE 0 END", "obs") for c in every],
        ("gap_over_24h", "ts", "warning", "count(*) FILTER (gap > 86400000000)", "(SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY station ORDER BY ts, event_id) AS gap FROM obs)"),
        ("low_completeness", "ts", "warning", f"CASE WHEN count(*) / {span} < 0.8 THEN 1 ELSE 0 END", "obs"),
    ]
    return " UNION ALL ".join(f"""SELECT '{a}' AS "check", '{b}' AS "column", '{c}' AS severity, CAST({n} AS BIGINT) AS n FROM {t}""" for a, b, c, n, t in rows)


@query("validation_report", "Q-09", _report_sql())
def _(spark, d):
    return quality.validation_report(
        S.observations(spark, d), RULES, ["event_id", "ts", "station"], TYPES, ["station", "ts"]
    )


_FINDINGS = [  # (severity, SQL of the number of violations)
    ("warning", "SELECT 1"),  # event_id is declared as text and is a number
    ("warning", "SELECT count(*) FILTER (temperature_c < -5) FROM obs"),
    ("warning", "SELECT count(*) FILTER (temperature_c > 25) FROM obs"),
    ("error", "SELECT count(*) - count(temperature_c) FROM obs"),
    ("warning", "SELECT count(*) FILTER (wind_speed_kt < 0) FROM obs"),
    ("warning", "SELECT count(*) FILTER (wind_speed_kt > 40) FROM obs"),
    ("warning", "SELECT count(*) FILTER (ceiling_ft < 100) FROM obs"),
    ("error", "SELECT count(*) - count(ceiling_ft) FROM obs"),
    ("warning", "SELECT count(*) FILTER (NOT station IN ('EGLL', 'LSZH', 'LFPG')) FROM obs"),
    ("warning", "SELECT count(*) FILTER (temperature_c < dewpoint_c) FROM obs"),
    ("warning", "SELECT count(*) FILTER (wind_gust_kt < wind_speed_kt) FROM obs"),
    ("error", "SELECT count(*) - count(DISTINCT (station, ts)) FROM obs"),
    ("warning", "SELECT CASE WHEN count(*) - count(DISTINCT event_id) > 0.1 * count(*) THEN 1 ELSE 0 END FROM obs"),
    ("warning", """SELECT count(*) FILTER (gap > 86400000000) FROM (SELECT epoch_us(ts) - lag(epoch_us(ts))
      OVER (PARTITION BY station ORDER BY ts, event_id) AS gap FROM obs)"""),
    ("warning", """SELECT CASE WHEN count(*) / (CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / 1800000000) < 0.8
      THEN 1 ELSE 0 END FROM obs"""),
    *[
        ("warning", f"SELECT count(*) FILTER (abs(({c} - m) / s) > 3) FROM obs, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM obs)")
        for c in S.OBS_NUMERIC
    ],
    *[
        ("warning", f"SELECT CASE WHEN count(*) - count({c}) > 0.5 * count(*) THEN 1 ELSE 0 END FROM obs")
        for c in S.OBS_NUMERIC
    ],
]


@query(
    "validation_summary",
    "Q-09",
    "WITH f AS ("
    + " UNION ALL ".join(f"SELECT '{sev}' AS severity, ({sql}) AS n" for sev, sql in _FINDINGS)
    + """) SELECT count(*) FILTER (severity = 'error' AND n > 0) AS errors, count(*) FILTER (severity = 'warning' AND n > 0) AS warnings,
 count(*) FILTER (severity = 'error' AND n > 0) = 0 AS is_valid FROM f""",
)
def _(spark, d):
    obs = S.observations(spark, d)
    return quality.report_summary(quality.validation_report(obs, RULES, ["event_id", "ts"], TYPES, ["station", "ts"]))


_VOTES = ["wind_speed_kt > 35", "visibility_m < 500", "coalesce(ceiling_ft > 4500, false)"]


@query(
    "detector_vote",
    "Q-13",
    "SELECT event_id, CAST(("
    + " + ".join(f"CAST({v} AS INTEGER)" for v in _VOTES)
    + ") / CAST(3 AS DOUBLE) > 0.5 AS INTEGER) AS ensemble_anomaly FROM obs",
)
def _(spark, d):
    flags = [F.expr(f"CAST({v} AS INT)") for v in _VOTES]
    return S.observations(spark, d).select("event_id", quality.vote(flags).alias("ensemble_anomaly"))


_XC = ["temperature_c", "wind_speed_kt", "visibility_m", "pressure_hpa"]


@query(
    "explain_anomalies",
    "Q-14 O-05",
    "WITH s AS (SELECT "
    + ", ".join(
        f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}, quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}" for c in _XC
    )
    + """ FROM obs), f AS (SELECT * FROM obs, s WHERE visibility_m < 300 OR wind_speed_kt > 43),
z AS ("""
    + " UNION ALL ".join(
        f"SELECT event_id, '{c}' AS feature, abs(({c} - m_{c}) / s_{c}) AS z FROM f WHERE abs(({c} - m_{c}) / s_{c}) > 2" for c in _XC
    )
    + """), t AS (SELECT event_id, string_agg(feature, ',' ORDER BY z DESC, feature) AS names, count(*) AS n FROM
  (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY z DESC, feature) AS rn FROM z) WHERE rn <= 3 GROUP BY event_id),
x AS (SELECT event_id, """
    + " + ".join(f"CAST({c} < lo_{c} OR {c} > hi_{c} AS INTEGER)" for c in _XC)
    + " AS n, CASE "
    + " ".join(f"WHEN {c} < lo_{c} THEN '{c}_very_low' WHEN {c} > hi_{c} THEN '{c}_very_high'" for c in _XC)
    + """ END AS first_one FROM f)
SELECT x.event_id, coalesce(t.names, '') AS unusual_features, CASE WHEN x.n >= 3 THEN 'multivariate_extreme'
 WHEN x.n > 0 THEN 'extreme_' || first_one ELSE 'subtle_anomaly' END AS anomaly_type FROM x LEFT JOIN t ON x.event_id = t.event_id""",
)
def _(spark, d):
    flagged = S.observations(spark, d).withColumn("flag", F.expr("CAST(visibility_m < 300 OR wind_speed_kt > 43 AS INT)"))
    out = quality.explain_anomalies(flagged, "flag", _XC, "event_id")
    return out.select("event_id", F.array_join("unusual_features", ",").alias("unusual_features"), "anomaly_type")


# ---------------------------------------------------------------- missing values and completeness

_MISS = ["temperature_c", "wind_gust_kt", "ceiling_ft", "visibility_m"]


@query(
    "missing_by_column",
    "A-11",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, {r(f'(count(*) - count({c})) / CAST(count(*) AS DOUBLE)')} AS ratio FROM obs"
        for c in _MISS
    )
    + " UNION ALL SELECT '(all)', "
    + " + ".join(f"(count(*) - count({c}))" for c in _MISS)
    + ", "
    + r("(" + " + ".join(f"(count(*) - count({c}))" for c in _MISS) + f") / CAST(count(*) * {len(_MISS)} AS DOUBLE)")
    + " FROM obs",
)
def _(spark, d):
    return quality.missing_by_column(S.observations(spark, d), _MISS).withColumn("ratio", rnd("ratio"))


@query(
    "missing_per_hour_pattern",
    "A-12",
    f"""WITH h AS (SELECT unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS h FROM obs),
 m AS (SELECT date_trunc('hour', ts) AS h, sum(CAST(wind_gust_kt IS NULL AS INTEGER) + CAST(ceiling_ft IS NULL AS INTEGER)) AS m FROM obs GROUP BY ALL),
 j AS (SELECT coalesce(m.m, 0) AS m FROM h LEFT JOIN m ON h.h = m.h)
SELECT count(*) AS hours, {r('avg(m)')} AS mean_missing, {r('stddev_samp(m)')} AS std_missing, stddev_samp(m) > avg(m) AS non_uniform FROM j""",
)
def _(spark, d):
    out = quality.missing_pattern(S.observations(spark, d), ["wind_gust_kt", "ceiling_ft"])
    return out.withColumns({c: rnd(c) for c in ("mean_missing", "std_missing")})


# ---------------------------------------------------------------- drift

_FC = S.FEATURES


def _halves(spark, d):
    f = S.features(spark, d)
    cut = F.lit("1998-06-01").cast("timestamp_ntz")
    return f.where(F.col("l_shipdate") < cut), f.where(F.col("l_shipdate") >= cut)


_SIDES = "s AS (SELECT *, l_shipdate < TIMESTAMP '1998-06-01' AS is_ref FROM features)"


@query(
    "ks_statistics",
    "Q-15",
    f"WITH {_SIDES}, "
    + ", ".join(
        f"""c{i} AS (SELECT '{c}' AS feature, n_ref, n_cur, max(abs(cr / n_ref - cc / n_cur)) AS d FROM (
  SELECT {c}, sum(sum(CAST(is_ref AS DOUBLE))) OVER (ORDER BY {c}) AS cr, sum(sum(1 - CAST(is_ref AS DOUBLE))) OVER (ORDER BY {c}) AS cc
  FROM s GROUP BY {c}), (SELECT count(*) FILTER (is_ref) AS n_ref, count(*) FILTER (NOT is_ref) AS n_cur FROM s) GROUP BY ALL)"""
        for i, c in enumerate(_FC)
    )
    + " "
    + " UNION ALL ".join(f"SELECT feature, n_ref, n_cur, {r('d')} AS ks FROM c{i}" for i in range(len(_FC))),
)
def _(spark, d):
    return drift.ks_statistic(*_halves(spark, d), _FC).withColumn("ks", rnd("ks"))


@query(
    "chi2_drift_statistics",
    "Q-16",
    f"WITH {_SIDES}, "
    + ", ".join(
        f"""h{i} AS (SELECT bin, CAST(count(*) FILTER (is_ref) AS DOUBLE) / any_value(nr) AS p, CAST(count(*) FILTER (NOT is_ref) AS DOUBLE) / any_value(nc) AS q FROM (
  SELECT is_ref, nr, nc, least(floor(({c} - lo) / ((hi - lo) / 10)), 9) AS bin FROM s,
   (SELECT min({c}) AS lo, max({c}) AS hi, count(*) FILTER (is_ref) AS nr, count(*) FILTER (NOT is_ref) AS nc FROM s)) GROUP BY bin)"""
        for i, c in enumerate(_FC)
    )
    + " "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {r('sum((q - p) * (q - p) / (p + 1e-10::DOUBLE))', 9)} AS chi2 FROM h{i}" for i, c in enumerate(_FC)
    ),
)
def _(spark, d):
    return drift.chi2_statistic(*_halves(spark, d), _FC).withColumn("chi2", rnd("chi2", 9))


def _drift_sql():
    """The two statistics as above, their p-values as series, and the verdicts."""
    ks = ", ".join(
        f"""c{i} AS (SELECT '{c}' AS feature, n_ref, n_cur, max(abs(cr / n_ref - cc / n_cur)) AS ks FROM (
  SELECT {c}, sum(sum(CAST(is_ref AS DOUBLE))) OVER (ORDER BY {c}) AS cr, sum(sum(1 - CAST(is_ref AS DOUBLE))) OVER (ORDER BY {c}) AS cc
  FROM s GROUP BY {c}), (SELECT count(*) FILTER (is_ref) AS n_ref, count(*) FILTER (NOT is_ref) AS n_cur FROM s) GROUP BY ALL),
 h{i} AS (SELECT bin, CAST(count(*) FILTER (is_ref) AS DOUBLE) / any_value(nr) AS p, CAST(count(*) FILTER (NOT is_ref) AS DOUBLE) / any_value(nc) AS q FROM (
  SELECT is_ref, nr, nc, least(floor(({c} - lo) / ((hi - lo) / 10)), 9) AS bin FROM s,
   (SELECT min({c}) AS lo, max({c}) AS hi, count(*) FILTER (is_ref) AS nr, count(*) FILTER (NOT is_ref) AS nc FROM s)) GROUP BY bin)"""
        for i, c in enumerate(_FC)
    )
    both = " UNION ALL ".join(f"SELECT c{i}.*, (SELECT sum((q - p) * (q - p) / (p + 1e-10::DOUBLE)) FROM h{i}) AS chi2 FROM c{i}" for i in range(len(_FC)))
    return f"""WITH {_SIDES}, {ks}, b AS ({both}), t AS (SELECT *, ks * sqrt(n_ref * n_cur / CAST(n_ref + n_cur AS DOUBLE)) AS z, sqrt(chi2 / 2) AS x, chi2 / 2 AS y FROM b),
 v AS (SELECT *, CASE WHEN z < 0.2 THEN 1 ELSE greatest(0, least(1, 2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * z * z))))) END AS ks_p,
  least(1, 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 60), lambda n: (CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) * pow(x, 2 * n + 1) / gamma(n + 1) / (2 * n + 1)))
   + list_sum(list_transform([0.5, 1.5, 2.5, 3.5], lambda a: pow(y, a::DOUBLE) * exp(-y) / gamma(a::DOUBLE + 1)))) AS chi2_p FROM t),
 w AS (SELECT *, 1 - least(ks_p, chi2_p) AS drift_score, least(ks_p, chi2_p) < 0.05 AS drifted FROM v)
SELECT feature, {r("ks")} AS ks, {r("ks_p")} AS ks_p, {r("chi2", 9)} AS chi2, {r("chi2_p")} AS chi2_p, {r("drift_score")} AS drift_score, drifted,
 (SELECT count(*) FILTER (drifted) > 0.3 * count(*) FROM w) AS overall_drift FROM w"""


@query("drift_report", "Q-15 Q-16 Q-17", _drift_sql())
def _(spark, d):
    out = drift.drift_report(*_halves(spark, d), _FC).withColumn("chi2", rnd("chi2", 9))
    return out.withColumns({c: rnd(c) + F.lit(0.0) for c in ("ks", "ks_p", "chi2_p", "drift_score")})


# ---------------------------------------------------------------- summaries


@query(
    "station_statistics",
    "A-03",
    f"""SELECT station, count(*) AS total, count(*) FILTER (NOT cancelled) AS active, count(*) FILTER (cancelled) AS cancelled,
 {r('count(*) FILTER (cancelled) / CAST(count(*) AS DOUBLE) * 100')} AS cancel_rate, min(start_time) AS first_start, max(start_time) AS last_start,
 {r('coalesce(avg(duration_min) FILTER (NOT cancelled), 0)')} AS avg_duration_min,
 CAST(coalesce(sum(delay_min) FILTER (NOT cancelled), 0) AS BIGINT) AS total_delay_min FROM intervals GROUP BY station""",
)
def _(spark, d):
    out = summaries.station_statistics(S.intervals(spark, d))
    return out.withColumns({c: rnd(c) for c in ("cancel_rate", "avg_duration_min")})


@query(
    "top_interval_reasons",
    "A-04",
    f"""SELECT reason, count(*) AS n, {r('count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100')} AS share FROM active
GROUP BY reason ORDER BY n DESC, reason NULLS LAST LIMIT 10""",
)
def _(spark, d):
    active = filters.usable_intervals(S.intervals(spark, d), None, None)
    return summaries.value_shares(active, "reason", top=10).withColumn("share", rnd("share"))


_CAUSE = """CASE WHEN regexp_matches(lower(description), 'cb|rain|show|thunderstorm') THEN 'CB'
 WHEN regexp_matches(lower(description), 'visibility|ceiling|vis|lvp|l\\.v\\.p\\.') THEN 'VISIBILITY/CEILING'
 WHEN contains(lower(description), 'wind') THEN 'WIND' WHEN contains(lower(description), 'fog') THEN 'FOG'
 WHEN regexp_matches(lower(description), 'snow|freez|icing|ice') THEN 'SNOW/ICE' ELSE 'OTHER' END"""


@query(
    "cause_shares_by_station",
    "A-05 T-04",
    f"""WITH c AS (SELECT station, {_CAUSE} AS cause FROM causes)
SELECT station, cause, count(*) AS n, {r('count(*) / CAST(sum(count(*)) OVER (PARTITION BY station) AS DOUBLE) * 100')} AS share FROM c GROUP BY station, cause""",
)
def _(spark, d):
    classed = S.causes(spark, d).select("station", cause_class("description").alias("cause"))
    return summaries.value_shares(classed, "cause", ["station"]).withColumn("share", rnd("share"))


@query(
    "delay_by_station",
    "A-06",
    "SELECT station, count(*) AS n, CAST(sum(delay_min) AS BIGINT) AS total_delay_min FROM intervals GROUP BY station",
)
def _(spark, d):
    return (
        S.intervals(spark, d)
        .groupBy("station")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("delay_min").alias("total_delay_min"))
    )


@query(
    "describe_columns",
    "A-09",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count({c}) AS \"count\", {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std, "
        + ", ".join(
            f"{r(f'quantile_cont({c}, {q})')} AS {n}"
            for n, q in (("min", 0), ("q25", 0.25), ("median", 0.5), ("q75", 0.75), ("max", 1))
        )
        + " FROM obs"
        for c in S.OBS_NUMERIC
    ),
)
def _(spark, d):
    return zeroed(summaries.describe(S.observations(spark, d), S.OBS_NUMERIC), ["feature", "count"])


@query(
    "histogram_by_station",
    "A-10",
    f"""WITH b AS (SELECT station, CAST(least(floor((temperature_c - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin, lo + least(floor((temperature_c - lo) / ((hi - lo) / 30)), 29) * ((hi - lo) / 30) AS s
 FROM obs, (SELECT min(temperature_c) AS lo, max(temperature_c) AS hi FROM obs))
SELECT station, bin, count(*) AS n, {r('any_value(s)', 4)} AS bin_start FROM b GROUP BY station, bin""",
)
def _(spark, d):
    out = summaries.histogram(S.observations(spark, d), "temperature_c", 30, ["station"])
    return zeroed(out, ["station", "bin", "n"], 4)


@query(
    "box_summary_by_class",
    "A-10",
    "SELECT y, count(*) AS n, "
    + ", ".join(
        f"{r(f'quantile_cont(l_extendedprice, {q})', 4)} AS {n}"
        for n, q in (("lowest", 0), ("q25", 0.25), ("median", 0.5), ("q75", 0.75), ("highest", 1))
    )
    + " FROM features GROUP BY y",
)
def _(spark, d):
    return zeroed(summaries.box_summary(S.features(spark, d), "l_extendedprice", ["y"]), ["y", "n"], 4)


@query(
    "feature_report",
    "A-13",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, '{k}' AS kind, '{t}' AS type, count(DISTINCT {c}) AS distinct_values FROM obs"
        for c, k, t in [("station", "categorical", "string"), *[(c, "numerical", "double") for c in S.OBS_NUMERIC]]
    ),
)
def _(spark, d):
    return summaries.feature_report(S.observations(spark, d), ["station", *S.OBS_NUMERIC])


@query(
    "dataset_summary",
    "A-14",
    f"""SELECT count(*) AS "rows", {len(S.OBS_NUMERIC)} AS "columns", min(ts) AS first_ts, max(ts) AS last_ts, """
    + r(
        "(" + " + ".join(f"(count(*) - count({c}))" for c in S.OBS_NUMERIC) + f") / CAST(count(*) * {len(S.OBS_NUMERIC)} AS DOUBLE)"
    )
    + " AS missing_ratio FROM obs",
)
def _(spark, d):
    out = summaries.dataset_summary(S.observations(spark, d), S.OBS_NUMERIC)
    return out.withColumn("missing_ratio", rnd("missing_ratio"))


@query("content_hash", "A-14")
def _(spark, d):
    return summaries.content_hash(S.observations(spark, d))
