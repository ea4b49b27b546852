"""Lag, rolling, fill, seasonal and sequence features of the observation series."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerogrid.functions.num import flag, rnd
from aerogrid.operators import filters, grid, intervals, ordering, prep, windows
from aerogrid.plans.oracle_views import r
from aerogrid.plans.registry import query
from aerogrid.session import settle
from aerogrid.sources import standins as S

W_SQL = "WINDOW w AS (PARTITION BY station ORDER BY ts, event_id)"


def labelled(spark, d):
    """Observations with y = 1 while an active interval covers them (half-open)."""
    active = filters.usable_intervals(S.intervals(spark, d), None, None)
    obs = S.observations(spark, d)
    return intervals.label_points(obs, active).select(*obs.columns, flag(F.col("active") == 1).alias("y"))


def zeroed(df, keys, digits=6):
    """Round every column but the keys, without negative zeros."""
    return df.select(*keys, *[(rnd(c, digits) + F.lit(0.0)).alias(c) for c in df.columns if c not in keys])


_LAGS = (1, 2, 3, 6, 12, 24)


@query(
    "lag_features",
    "W-01",
    "SELECT event_id, "
    + ", ".join(f"lag({c}, {k}) OVER w AS {c}_lag_{k}" for c in S.OBS_NUMERIC for k in _LAGS)
    + f" FROM obs {W_SQL}",
)
def _(spark, d):
    return windows.with_lags(S.observations(spark, d), S.OBS_NUMERIC, _LAGS, keep=["event_id"])


@query(
    "lag_differences",
    "W-02",
    "SELECT event_id, "
    + ", ".join(
        f"{r(f'{c} - lag({c}, {k}) OVER w', 4)} AS {c}_lag_diff_{k}"
        for c in ("temperature_c", "visibility_m")
        for k in _LAGS[1:]
    )
    + f" FROM obs {W_SQL}",
)
def _(spark, d):
    cols = ("temperature_c", "visibility_m")
    out = windows.with_lags(S.observations(spark, d), cols, _LAGS, differences=True, keep=["event_id"])
    return zeroed(out.select("event_id", *[c for c in out.columns if "_lag_diff_" in c]), ["event_id"], 4)


_DERIV = ("temperature_c", "pressure_hpa", "wind_speed_kt", "visibility_m")


def _diff_sql(c):
    d = [f"(lag({c}, {k}) OVER w - lag({c}, {k + 1}) OVER w)" if k else f"({c} - lag({c}, 1) OVER w)" for k in range(3)]
    return d


@query(
    "first_and_second_difference",
    "W-03",
    "SELECT event_id, "
    + ", ".join(
        f"{r(_diff_sql(c)[0], 4)} AS {c}_diff, {r(_diff_sql(c)[0] + ' - ' + _diff_sql(c)[1], 4)} AS {c}_diff2" for c in _DERIV
    )
    + f" FROM obs {W_SQL}",
)
def _(spark, d):
    out = windows.with_derivatives(S.observations(spark, d), _DERIV, keep=["event_id"])
    return zeroed(out.select("event_id", *[c for c in out.columns if c.endswith(("_diff", "_diff2"))]), ["event_id"], 4)


@query(
    "difference_mean_of_three",
    "W-04",
    "SELECT event_id, "
    + ", ".join(f"{r('(' + ' + '.join(_diff_sql(c)) + ') / 3', 4)} AS {c}_diff_ma3" for c in _DERIV)
    + f" FROM obs {W_SQL}",
)
def _(spark, d):
    out = windows.with_derivatives(S.observations(spark, d), _DERIV, keep=["event_id"])
    return zeroed(out.select("event_id", *[c for c in out.columns if c.endswith("_diff_ma3")]), ["event_id"], 4)


_ROLL = (3, 6, 12, 24)


def _frame(n):
    return f"(PARTITION BY station ORDER BY ts, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _guard(c, n, e):
    return f"CASE WHEN count({c}) OVER w{n} = {n} THEN {e} END"


_FRAMES = "WINDOW " + ", ".join(f"w{n} AS {_frame(n)}" for n in _ROLL)
_RC = ("temperature_c", "wind_gust_kt", "visibility_m")


@query(
    "rolling_statistics",
    "W-05",
    "SELECT event_id, "
    + ", ".join(
        f"{r(_guard(c, n, f'{fn}({c}) OVER w{n}'), 4)} AS {c}_roll_{s}_{n}"
        for c in _RC
        for n in _ROLL
        for s, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))
    )
    + f" FROM obs {_FRAMES}",
)
def _(spark, d):
    return zeroed(windows.with_rolling(S.observations(spark, d), _RC, _ROLL, keep=["event_id"]), ["event_id"], 4)


@query(
    "rolling_median",
    "W-06",
    "SELECT event_id, "
    + ", ".join(f"{r(_guard(c, n, f'median({c}) OVER w{n}'))} AS {c}_roll_median_{n}" for c in _RC for n in _ROLL)
    + f" FROM obs {_FRAMES}",
)
def _(spark, d):
    out = windows.with_rolling(S.observations(spark, d), _RC, _ROLL, ("median",), keep=["event_id"])
    return zeroed(out, ["event_id"])


@query(
    "rolling_skew_and_kurtosis",
    "W-07",
    "WITH f AS (SELECT event_id, "
    + ", ".join(
        f"CASE WHEN count({c}) OVER w{n} = {n} THEN list({c}) OVER w{n} END AS {c}_{n}"
        for c in ("temperature_c", "wind_speed_kt")
        for n in _ROLL
    )
    + f" FROM obs {_FRAMES}) SELECT event_id, "
    + ", ".join(
        r(f"CASE WHEN list_max({c}_{n}) = list_min({c}_{n}) THEN 0 ELSE list_skewness({c}_{n}) END", 3)
        + f" AS {c}_roll_skew_{n}, "
        + (
            r(f"CASE WHEN list_max({c}_{n}) = list_min({c}_{n}) THEN -3 ELSE list_kurtosis({c}_{n}) END", 3)
            if n > 3
            else "CAST(NULL AS DOUBLE)"
        )
        + f" AS {c}_roll_kurt_{n}"
        for c in ("temperature_c", "wind_speed_kt")
        for n in _ROLL
    )
    + " FROM f",
)
def _(spark, d):
    cols = ("temperature_c", "wind_speed_kt")
    out = windows.with_rolling(S.observations(spark, d), cols, _ROLL, ("skew", "kurt"), keep=["event_id"])
    return zeroed(out, ["event_id"], 3)


@query(
    "rolling_trend_and_zscore",
    "W-08",
    "SELECT event_id, "
    + ", ".join(
        r(_guard(c, n, f"{c} - avg({c}) OVER w{n}"), 4)
        + f" AS {c}_roll_trend_{n}, "
        + r(_guard(c, n, f"CASE WHEN stddev_samp({c}) OVER w{n} > 0 THEN ({c} - avg({c}) OVER w{n}) / (stddev_samp({c}) OVER w{n} + 1e-8::DOUBLE) ELSE 0 END"), 4)
        + f" AS {c}_roll_zscore_{n}"
        for c in ("temperature_c", "wind_speed_kt")
        for n in (6, 24)
    )
    + f" FROM obs {_FRAMES}",
)
def _(spark, d):
    cols = ("temperature_c", "wind_speed_kt")
    out = windows.with_rolling(S.observations(spark, d), cols, (6, 24), ("trend", "zscore"), keep=["event_id"])
    return zeroed(out, ["event_id"], 4)


@query(
    "pressure_tendency",
    "W-09",
    f"""WITH t AS (SELECT event_id, ({' + '.join(_diff_sql('pressure_hpa'))}) / 3 AS m FROM obs {W_SQL})
SELECT event_id, {r('m', 4)} AS pressure_tendency, CAST(coalesce(m < -0.5::DOUBLE, false) AS INTEGER) AS pressure_dropping,
 CAST(coalesce(m > 0.5::DOUBLE, false) AS INTEGER) AS pressure_rising FROM t""",
)
def _(spark, d):
    out = windows.with_pressure_tendency(S.observations(spark, d), "pressure_hpa", keep=["event_id"])
    return out.withColumn("pressure_tendency", rnd("pressure_tendency", 4) + F.lit(0.0))


@query(
    "rolling_entropy",
    "W-10",
    f"""WITH f AS (SELECT event_id, ts, CASE WHEN count(q) OVER w = 24 THEN list(q) OVER w END AS l
 FROM (SELECT *, floor(wind_direction / 30) AS q FROM obs)
 WINDOW w AS (PARTITION BY station ORDER BY ts, event_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
c AS (SELECT event_id, v, count(*) + 1e-8::DOUBLE AS n FROM (SELECT event_id, unnest(l) AS v FROM f WHERE l IS NOT NULL) GROUP BY ALL),
p AS (SELECT event_id, n / sum(n) OVER (PARTITION BY event_id) AS p FROM c),
e AS (SELECT event_id, sum(-p * ln(p)) AS h FROM p GROUP BY event_id)
SELECT f.event_id, {r('h')} AS wind_sector_entropy FROM f LEFT JOIN e ON f.event_id = e.event_id""",
)
def _(spark, d):
    obs = S.observations(spark, d).withColumn("wind_sector", F.floor(F.col("wind_direction") / 30))
    return zeroed(windows.with_entropy(obs, "wind_sector", 24, keep=["event_id"]), ["event_id"])


@query(
    "seasonal_decomposition",
    "W-14",
    f"""WITH t AS (SELECT event_id, station, temperature_c AS x, row_number() OVER w - 1 AS rn, count(*) OVER (PARTITION BY station) AS n,
  (sum(temperature_c) OVER (PARTITION BY station ORDER BY ts, event_id ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)
   - (lag(temperature_c, 12) OVER w + lead(temperature_c, 12) OVER w) / 2) / 24 AS trend FROM obs {W_SQL}),
 p AS (SELECT station, rn % 24 AS ph, avg(x - trend) AS m FROM t GROUP BY ALL),
 s AS (SELECT station, ph, m - avg(m) OVER (PARTITION BY station) AS season FROM p)
SELECT event_id, {r('CASE WHEN n > 48 THEN trend END', 7)} AS temperature_c_trend,
 {r('CASE WHEN n > 48 THEN season END', 7)} AS temperature_c_seasonal,
 {r('CASE WHEN n > 48 THEN x - trend - season END', 7)} AS temperature_c_residual
FROM t JOIN s ON t.station = s.station AND t.rn % 24 = s.ph""",
)
def _(spark, d):
    out = windows.seasonal_decompose(S.observations(spark, d), "temperature_c")
    return zeroed(out.drop("station", "ts", "temperature_c"), ["event_id"], 7)


@query(
    "forward_fill_one_hour",
    "W-11",
    "SELECT g.station, g.ts, "
    + ", ".join(
        f"{r(f'last_value({c} IGNORE NULLS) OVER w', 8)} AS {c}" for c in ("temperature_c", "visibility_m", "ceiling_ft")
    )
    + """ FROM grid g LEFT JOIN resampled s ON g.station = s.station AND g.ts = s.ts
WINDOW w AS (PARTITION BY g.station ORDER BY g.ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
)
def _(spark, d):
    out = grid.on_grid(S.observations(spark, d)).select("station", "ts", "temperature_c", "visibility_m", "ceiling_ft")
    return zeroed(out, ["station", "ts"], 8)


@query(
    "fill_both_ways",
    "W-12",
    """WITH f AS (SELECT event_id, station, ts, last_value(wind_gust_kt IGNORE NULLS) OVER (PARTITION BY station ORDER BY ts, event_id
  ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS g FROM obs)
SELECT event_id, first_value(g IGNORE NULLS) OVER (PARTITION BY station ORDER BY ts, event_id
  ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS wind_gust_kt FROM f""",
)
def _(spark, d):
    obs = S.observations(spark, d).select("event_id", "station", "ts", "wind_gust_kt")
    return grid.fill_both_ways(obs, 2, ["wind_gust_kt"], tie="event_id").select("event_id", "wind_gust_kt")


@query(
    "fill_whole_series",
    "W-13",
    """SELECT event_id, coalesce(last_value(sparse IGNORE NULLS) OVER (PARTITION BY station ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(sparse IGNORE NULLS) OVER (PARTITION BY station
  ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled
FROM (SELECT *, CASE WHEN event_id % 97 = 50 THEN ceiling_ft END AS sparse FROM obs)""",
)
def _(spark, d):
    sparse = F.when(F.col("event_id") % 97 == 50, F.col("ceiling_ft")).alias("filled")
    obs = S.observations(spark, d).select("event_id", "station", "ts", sparse)
    return ordering.fill_series(obs, ["filled"]).select("event_id", "filled")


@query(
    "time_gaps",
    "W-15",
    """WITH g AS (SELECT station, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap FROM obs WINDOW w AS (PARTITION BY station ORDER BY ts, event_id)),
 j AS (SELECT station, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY station ORDER BY event_id) AS jump FROM obs)
SELECT g.station, g.large_gaps, g.longest_gap_us, j.backward_jumps FROM
 (SELECT station, count(*) FILTER (gap > 10800000000) AS large_gaps, max(gap) AS longest_gap_us FROM g GROUP BY station) g
 JOIN (SELECT station, count(*) FILTER (jump < 0) AS backward_jumps FROM j GROUP BY station) j ON g.station = j.station""",
)
def _(spark, d):
    return grid.time_gaps(S.observations(spark, d), limit_hours=3)


@query(
    "fill_report_gaps",
    "W-16",
    """WITH n AS (SELECT event_id, station, ts, temperature_c, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS gap FROM obs
  WINDOW w AS (PARTITION BY station ORDER BY ts, event_id)),
 c AS (SELECT *, unnest(generate_series(0, CASE WHEN gap > 1800000000 THEN greatest(gap // 1800000000 - 1, 0) ELSE 0 END)) AS "copy" FROM n)
SELECT station, event_id, ts + to_minutes(30 * "copy") AS ts, "copy", temperature_c FROM c""",
)
def _(spark, d):
    return grid.fill_gaps(S.observations(spark, d), ["temperature_c"], 30)


@query(
    "dilate_labels",
    "W-17",
    """WITH c AS (SELECT *, CAST(coalesce(y <> lag(y) OVER (PARTITION BY station ORDER BY ts, event_id), false) AS INTEGER) AS ch FROM labelled)
SELECT event_id, y, greatest(y, max(ch) OVER (PARTITION BY station ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
 AS y_dilated FROM c""",
)
def _(spark, d):
    return windows.dilate_labels(labelled(spark, d), "y", 3, keep=["event_id", "y"], sizes=S.observations(spark, d))


@query(
    "dilate_alternate_changes",
    "W-17",
    """WITH RECURSIVE o AS (SELECT event_id, station, ts, y, row_number() OVER (PARTITION BY station ORDER BY ts, event_id) AS p FROM labelled),
 s AS (SELECT station, p, y AS now, 0 AS skip, 0 AS ahead, 0 AS taken FROM o WHERE p = 1
  UNION ALL SELECT station, p, CASE WHEN change AND skip = 0 THEN 1 ELSE now END, CASE WHEN change THEN 1 - skip ELSE skip END,
   CASE WHEN change AND skip = 0 THEN 3 ELSE greatest(ahead - 1, 0) END, CASE WHEN change AND skip = 0 THEN 1 ELSE 0 END
  FROM (SELECT o.station, o.p, CASE WHEN s.ahead > 0 THEN 1 ELSE o.y END AS now, s.skip, s.ahead, (CASE WHEN s.ahead > 0 THEN 1 ELSE o.y END) <> s.now AS change
   FROM s JOIN o ON o.station = s.station AND o.p = s.p + 1))
SELECT o.event_id, o.y, greatest(o.y, max(s.taken) OVER (PARTITION BY o.station ORDER BY o.p ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) AS y_dilated
FROM o JOIN s ON o.station = s.station AND o.p = s.p""",
)
def _(spark, d):
    rows = settle(labelled(spark, d).select("event_id", "station", "ts", "y"))
    return windows.dilate_alternate(rows, "y").select("event_id", "y", "y_dilated")


_SEQ = ("temperature_c", "wind_speed_kt")


def _as_text(df):
    """Sequences as text: every step's values in tenths."""
    flat = F.transform(F.flatten("sequence"), lambda x: F.round(x * 10.0).cast("long").cast("string"))
    return df.select("event_id", "y", F.size("sequence").alias("steps"), F.array_join(flat, ",").alias("steps_text"))


_STEP_SQL = """CAST(CAST(round(temperature_c * 10) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(round(wind_speed_kt * 10) AS BIGINT) AS VARCHAR)"""


@query(
    "sequences_inclusive",
    "W-19",
    f"""WITH s AS (SELECT event_id, y, count(*) OVER w AS steps, string_agg({_STEP_SQL}, ',') OVER w AS steps_text FROM labelled
 WINDOW w AS (PARTITION BY station ORDER BY ts, event_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
SELECT event_id, y, CAST(steps AS INTEGER) AS steps, steps_text FROM s WHERE steps = 24""",
)
def _(spark, d):
    obs = S.observations(spark, d)
    return _as_text(windows.sequences(labelled(spark, d), _SEQ, "y", 24, keep=["event_id"], sizes=obs))


@query(
    "sequences_exclusive",
    "W-20",
    f"""WITH s AS (SELECT event_id, y, count(*) OVER w AS steps, string_agg({_STEP_SQL}, ',') OVER w AS steps_text FROM labelled
 WINDOW w AS (PARTITION BY station ORDER BY ts, event_id ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
SELECT event_id, y, CAST(steps AS INTEGER) AS steps, steps_text FROM s WHERE steps = 12""",
)
def _(spark, d):
    obs = S.observations(spark, d)
    return _as_text(
        windows.sequences(labelled(spark, d), _SEQ, "y", 12, False, keep=["event_id", "station"], sizes=obs)
    )


@query(
    "moving_average_for_display",
    "W-21",
    f"SELECT event_id, station, ts, {r(_guard('visibility_m', 24, 'avg(visibility_m) OVER w24'), 4)} AS visibility_ma24 FROM obs {_FRAMES}",
)
def _(spark, d):
    out = windows.with_rolling(
        S.observations(spark, d), ["visibility_m"], [24], ("mean",), keep=["event_id", "station", "ts"]
    )
    return out.select("event_id", "station", "ts", rnd("visibility_m_roll_mean_24", 4).alias("visibility_ma24"))


@query(
    "row_blocks_of_a_week",
    "W-22",
    """SELECT station, block, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (
 SELECT station, ts, (row_number() OVER w - 1) // 168 AS block FROM obs WINDOW w AS (PARTITION BY station ORDER BY ts, event_id)) GROUP BY ALL""",
)
def _(spark, d):
    blocks = windows.row_blocks(S.observations(spark, d), 168)
    return blocks.groupBy("station", "block").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


@query(
    "row_statistics",
    "A-21",
    "WITH u AS (SELECT event_id, unnest(["
    + ", ".join(S.OBS_NUMERIC)
    + f"""]) AS v FROM obs)
SELECT event_id, {r('avg(v)', 4)} AS row_mean, {r('stddev_samp(v)', 4)} AS row_std, {r('max(v)', 4)} AS row_max, {r('min(v)', 4)} AS row_min,
 {r('max(v) - min(v)', 4)} AS row_range FROM u GROUP BY event_id""",
)
def _(spark, d):
    out = prep.row_statistics(S.observations(spark, d), S.OBS_NUMERIC)
    keep = ["row_mean", "row_std", "row_max", "row_min", "row_range"]
    return zeroed(out.select("event_id", *keep), ["event_id"], 4)
