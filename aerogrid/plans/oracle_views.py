"""The stand-in views of `aerogrid.sources.standins` as SQL, for the check against a second engine."""

from __future__ import annotations

import re

from aerogrid.sources.standins import CAUSES, REASONS, STATIONS


def _pick(index: str, values: list) -> str:
    arms = " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(values))
    return f"CASE {index} {arms} END"


def _station(number: str) -> str:
    letters = " || ".join(f"chr(CAST(65 + {number} // {26**i} % 26 AS INTEGER))" for i in (3, 2, 1, 0))
    return f"coalesce({_pick(number, STATIONS)}, {letters})"


_SIGNED = "(CASE WHEN {c} < 0 THEN 'M' ELSE '' END || lpad(CAST(CAST(floor(abs({c}) + 0.5) AS BIGINT) AS VARCHAR), 2, '0'))"


def _digits(c: str, width: int) -> str:
    return f"lpad(CAST(CAST({c} AS BIGINT) AS VARCHAR), {width}, '0')"


VIEWS: dict[str, str] = {
    "base": f"""
SELECT event_id, ts, event_type, {_station('user_id')} AS station,
  CAST(round(value * 100) AS BIGINT) AS vc,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
FROM events""",
    "obs": """
SELECT event_id, ts, station, temperature_c,
  round(temperature_c - CAST(vc % 120 AS DOUBLE) / CAST(10 AS DOUBLE), 1) AS dewpoint_c,
  CAST(vc % 45 AS DOUBLE) AS wind_speed_kt, CAST((vc * 7) % 361 AS DOUBLE) AS wind_direction,
  CASE WHEN vc % 3 = 0 THEN CAST(vc % 45 + vc % 15 AS DOUBLE) END AS wind_gust_kt,
  CASE WHEN event_type = 'error' THEN CAST((vc % 20) * 100 AS DOUBLE)
       ELSE CAST(least(9999, 1000 + (vc % 100) * 100) AS DOUBLE) END AS visibility_m,
  CASE WHEN k % 10 <> 0 THEN CAST(k * 50 AS DOUBLE) END AS ceiling_ft,
  round(CAST(980 AS DOUBLE) + CAST(k AS DOUBLE) * CAST(0.7 AS DOUBLE), 1) AS pressure_hpa
FROM (SELECT *, round(CAST(k AS DOUBLE) * CAST(0.4 AS DOUBLE) - CAST(10 AS DOUBLE), 1) AS temperature_c FROM base)""",
    "intervals": f"""
SELECT station, CASE WHEN vc % 10 = 9 THEN 'Airspace' ELSE 'Aerodrome' END AS location_type,
  date_trunc('minute', ts) AS start_time,
  date_trunc('minute', ts) + to_minutes(30 + vc % 240) AS end_time,
  {_pick('k % 8', REASONS)} AS reason,
  'due to ' || coalesce({_pick('k % 8', REASONS)}, 'unknown') AS description,
  k % 4 = 0 AS cancelled, 30 + vc % 240 AS duration_min, vc % 500 AS delay_min, vc % 60 AS traffic,
  vc % 5 AS severity, event_id AS ordinal
FROM base WHERE event_type = 'error'""",
    "raw_report": f"""
SELECT event_id, station, ts, year(ts) AS "year", month(ts) AS "month", day(ts) AS "day", hour(ts) AS "hour",
  minute(ts) AS "minute",
  (CASE WHEN event_id % 19 = 0 THEN 'SPECI ' ELSE 'METAR ' END) || station || ' ' || strftime(ts, '%d%H%M') || 'Z ' ||
  (CASE WHEN event_id % 17 = 0 THEN '/////KT' ELSE
    (CASE WHEN event_id % 11 = 0 THEN 'VRB' ELSE {_digits('wind_direction', 3)} END) || {_digits('wind_speed_kt', 2)} ||
    (CASE WHEN wind_gust_kt IS NOT NULL THEN 'G' || {_digits('wind_gust_kt', 2)} ELSE '' END) || 'KT' END) || ' ' ||
  {_digits('visibility_m', 4)} ||
  (CASE WHEN visibility_m < 1000 THEN ' FG' WHEN wind_speed_kt > 40 THEN ' TSRA' ELSE '' END) ||
  (CASE WHEN ceiling_ft IS NULL THEN '' ELSE ' FEW' || {_digits('floor(ceiling_ft / 200)', 3)} ||
    (CASE WHEN event_id % 2 = 0 THEN ' BKN' ELSE ' OVC' END) || {_digits('floor(ceiling_ft / 100)', 3)} ||
    (CASE WHEN event_id % 5 = 0 THEN ' SCT' || {_digits('floor(ceiling_ft / 50)', 3)} ELSE '' END) END) ||
  (CASE WHEN event_id % 13 = 0 THEN '' ELSE ' ' || {_SIGNED.format(c='temperature_c')} || '/' || {_SIGNED.format(c='dewpoint_c')} END) ||
  ' Q' || {_digits('floor(pressure_hpa)', 4)} AS report
FROM obs""",
    "forecast": """
SELECT station, issue_time, issue_time AS valid_from, issue_time + INTERVAL 9 HOUR AS valid_to,
  wind_speed_kt, wind_direction, visibility_m, ceiling_ft
FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') AS issue_time,
        row_number() OVER (PARTITION BY station, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') ORDER BY ts, event_id) AS rn
      FROM obs) WHERE rn = 1""",
    "causes": f"""
SELECT doc_id, {_station('(doc_id // 10)')} AS station, ({_pick('doc_id % 7', CAUSES)}) || ' ' || text AS description
FROM documents""",
    "features": """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_quantity, l_extendedprice, l_discount,
  CASE WHEN l_tax = 0 THEN CAST(0 AS DOUBLE) ELSE l_tax END AS l_tax, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y
FROM lineitem""",
    "scored": """
SELECT l_linestatus AS model, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
  l_discount * CAST(10 AS DOUBLE) AS score, l_orderkey AS row_key FROM lineitem""",
    "graded": "SELECT doc_id, quality AS y, toxic AS yhat FROM labels",
    "trials": """
SELECT p_partkey AS trial_id, p_brand AS model, p_type AS experiment,
  CASE WHEN p_partkey % 17 <> 0 THEN p_retailprice / CAST(2000 AS DOUBLE) END AS score,
  CASE WHEN p_partkey % 17 <> 0 THEN CAST(p_partkey * 7 % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS f1,
  CAST(p_size AS DOUBLE) AS time_s,
  CASE WHEN p_partkey % 17 = 0 THEN 'failed to fit' END AS error,
  DATE '2024-01-01' + CAST(p_partkey % 90 AS INTEGER) AS stored_on FROM part""",
    "categories": """
SELECT o_orderkey, o_orderpriority, o_orderstatus, c_mktsegment, o_totalprice,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "active": "SELECT * FROM intervals WHERE NOT cancelled",
    "grid_bounds": """
SELECT time_bucket(INTERVAL 30 MINUTE, min(ts), TIMESTAMP '2000-01-01') AS lo,
  time_bucket(INTERVAL 30 MINUTE, max(ts) + INTERVAL 30 MINUTE - INTERVAL 1 MICROSECOND, TIMESTAMP '2000-01-01') AS hi
FROM obs""",
    "grid": """
SELECT station, ts FROM (SELECT DISTINCT station FROM obs),
  (SELECT unnest(generate_series(lo, hi, INTERVAL 30 MINUTE)) AS ts FROM grid_bounds)""",
    "resampled": """
SELECT station, time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '2000-01-01') AS ts,
  avg(wind_speed_kt) AS wind_speed_kt, avg(wind_direction) AS wind_direction, max(wind_gust_kt) AS wind_gust_kt,
  min(visibility_m) AS visibility_m, min(ceiling_ft) AS ceiling_ft, avg(temperature_c) AS temperature_c,
  avg(dewpoint_c) AS dewpoint_c, avg(pressure_hpa) AS pressure_hpa
FROM obs GROUP BY ALL""",
    "labelled": """
SELECT o.*, CASE WHEN EXISTS (SELECT 1 FROM active a WHERE a.station = o.station AND o.ts >= a.start_time
   AND o.ts < a.end_time) THEN 1 ELSE 0 END AS y FROM obs o""",
    "windows": """
SELECT station, start_time - INTERVAL 6 HOUR AS window_start, end_time + INTERVAL 2 HOUR AS window_end, start_time,
  end_time, reason, CAST(duration_min AS DOUBLE) / CAST(60 AS DOUBLE) AS duration_hours, ordinal
FROM intervals WHERE NOT cancelled AND location_type = 'Aerodrome' AND duration_min >= 30""",
    "windowed": """
SELECT o.*,
  CASE WHEN count(CASE WHEN o.ts >= w.start_time AND o.ts < w.end_time THEN 1 END) > 0 THEN 1 ELSE 0 END AS has_regulation,
  CASE WHEN count(w.ordinal) > 0 THEN 1 ELSE 0 END AS in_window,
  arg_max(CAST(epoch_us(w.start_time) - epoch_us(o.ts) AS DOUBLE) / CAST(3600000000 AS DOUBLE), w.ordinal) AS time_to_regulation
FROM obs o LEFT JOIN windows w ON w.station = o.station AND o.ts >= w.window_start AND o.ts < w.window_end
GROUP BY ALL""",
}


def with_views(body: str) -> str:
    """Prefix a query body with the views it names, each after the views it needs itself."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, sql in VIEWS.items():
            if name not in needed and re.search(rf"(?<![\w.']){name}(?![\w(.'])", text):
                visit(sql)
                if name not in needed:
                    needed.append(name)

    body = body.strip()
    visit(body)
    if not needed:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in needed)
    if body.upper().startswith("PIVOT "):
        return f"SELECT * FROM (WITH {ctes}\n{body})"
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def r(expr: str, digits: int = 6) -> str:
    """Rounded value without a negative zero."""
    return f"(CASE WHEN round({expr}, {digits}) = 0 THEN CAST(0 AS DOUBLE) ELSE round({expr}, {digits}) END)"
