"""The balanced flow end to end: windows, labels, balancing, features, split, four models."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerogrid.functions.num import rnd
from aerogrid.operators import models
from aerogrid.plans import facades
from aerogrid.plans.oracle_views import r
from aerogrid.plans.registry import query
from aerogrid.sources import standins as S

_ROUNDED = ("temp_dewpoint_diff", "wind_temp_interaction")
_TAKEN = "least(w, CAST(floor(p * 0.7::DOUBLE) AS BIGINT))"

BALANCED_SQL = f"""WITH s AS (SELECT *, CASE WHEN has_regulation = 1 THEN 'positive' WHEN in_window = 1 THEN 'window' ELSE 'outside' END AS stratum FROM windowed),
 n AS (SELECT count(*) FILTER (stratum = 'positive') AS p, count(*) FILTER (stratum = 'window') AS w FROM s),
 k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(event_id || '|42'), event_id) AS rn FROM s),
 b AS (SELECT k.* FROM k, n WHERE stratum = 'positive' OR (stratum = 'window' AND rn <= {_TAKEN}) OR (stratum = 'outside' AND rn <= p - {_TAKEN})),
 m AS (SELECT quantile_cont(ceiling_ft, 0.5) AS med, CAST(floor(count(*) * 0.85::DOUBLE) AS BIGINT) AS hi FROM b),
 f AS (SELECT b.* EXCLUDE (ceiling_ft), coalesce(ceiling_ft, med) AS ceiling_ft, hi, row_number() OVER (ORDER BY ts, event_id) - 1 AS place FROM b, m)
SELECT event_id, station, ts, has_regulation, visibility_m, ceiling_ft, wind_speed_kt, wind_direction, temperature_c, dewpoint_c,
 hour(ts) AS "hour", isodow(ts) - 1 AS day_of_week, month(ts) AS "month", CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend,
 CAST(visibility_m < 5000 AS INTEGER) AS low_visibility, CAST(visibility_m < 1000 AS INTEGER) AS very_low_visibility,
 CAST(ceiling_ft < 1000 AS INTEGER) AS low_ceiling, CAST(ceiling_ft < 500 AS INTEGER) AS very_low_ceiling,
 CAST(wind_speed_kt > 15 AS INTEGER) AS high_wind, CAST(wind_speed_kt > 25 AS INTEGER) AS very_high_wind,
 {r("temperature_c - dewpoint_c", 4)} AS temp_dewpoint_diff, CAST(temperature_c - dewpoint_c < 3 AND visibility_m < 5000 AS INTEGER) AS fog_risk,
 {r("wind_speed_kt * temperature_c", 4)} AS wind_temp_interaction,
 CASE WHEN visibility_m >= 5000 AND ceiling_ft >= 3000 THEN 4 WHEN visibility_m >= 3000 AND ceiling_ft >= 1000 THEN 3
  WHEN visibility_m >= 1600 AND ceiling_ft >= 500 THEN 2 ELSE 1 END AS flight_category,
 CASE WHEN place < CAST(floor(hi * 0.82::DOUBLE) AS BIGINT) THEN 'train' WHEN place < hi THEN 'val' ELSE 'test' END AS split
FROM f"""


@query("balanced_dataset", "B-01 B-04 J-09 M-13", BALANCED_SQL)
def _(spark, d):
    rows = facades.balanced_dataset(S.observations(spark, d), S.intervals(spark, d))
    return rows.withColumns({c: rnd(c, 4) + F.lit(0.0) for c in _ROUNDED})


@query("balanced_models", "K-01 K-02 K-03 K-04 K-13")
def _(spark, d):
    runs = {kind: {"kind": kind} for kind in models.SETTINGS}
    return facades.balanced_models(facades.balanced_dataset(S.observations(spark, d), S.intervals(spark, d)), runs)
