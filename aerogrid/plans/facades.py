"""End-to-end flows composed from the operators; each is one lazy plan."""

from __future__ import annotations

from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerogrid.functions import timefeat as D
from aerogrid.functions import weather as M
from aerogrid.functions.num import numeric_columns, rnd
from aerogrid.functions import text as T
from aerogrid.functions.text import is_weather_reason
from aerogrid.operators import balance, filters, grid, intervals, metrics, models, ordering, prep
from aerogrid.session import settle

FORECAST_COLUMNS = ["wind_speed_kt", "wind_direction", "visibility_m", "ceiling_ft"]


def regulation_labels(steps: DataFrame, regulations: DataFrame, minutes: int, within: tuple | None = None) -> DataFrame:
    """Grid steps, all `within` a span if it is given, with has_regulation, has_weather_regulation and regulation_severity (closed bounds)."""
    measures = [
        intervals.ACTIVE,
        intervals.Measure("weather", "max", "CAST(is_weather_related AS INT)"),
    ]
    if "severity" in regulations.columns:
        measures.append(intervals.Measure("severity", "max", "severity"))
    out = intervals.grid_labels(steps, regulations, minutes, measures, "closed", within)
    severity = F.coalesce("severity", F.lit(0)) if "severity" in out.columns else F.lit(0)
    return out.select(
        *steps.columns,
        F.coalesce("active", F.lit(0)).alias("has_regulation"),
        F.coalesce("weather", F.lit(0)).alias("has_weather_regulation"),
        severity.alias("regulation_severity"),
    )


def feature_matrix(
    obs: DataFrame, forecasts: DataFrame | None, regulations: DataFrame, minutes: int = 30, start=None, end=None
) -> DataFrame:
    """Grid, resampled weather, forecasts, labels, clock and weather features, then the missing-value rules."""
    if start is not None and end is not None:
        obs = filters.filter_dates(obs, "ts", start, end)
    out = on_steps = grid.on_grid(obs, minutes)
    span = grid.grid_span(obs, minutes)
    strategy = grid.strategy_within(obs, span, minutes)
    if forecasts is not None:
        columns = [c for c in FORECAST_COLUMNS if c in forecasts.columns]
        out = grid.join_steps(out, grid.forecast_on_grid(forecasts, columns, minutes, within=span), "left", strategy)
    out = regulation_labels(out, filters.with_weather_flag(regulations), minutes, span)
    hour_sin, hour_cos = D.cyclical(D.hour("ts"), 24)
    month_sin, month_cos = D.cyclical(F.month("ts"), 12)
    out = out.select(
        "*",
        D.hour("ts").alias("hour"),
        D.day_of_week("ts").alias("day_of_week"),
        F.month("ts").alias("month"),
        D.is_weekend("ts").alias("is_weekend"),
        hour_sin.alias("hour_sin"),
        hour_cos.alias("hour_cos"),
        month_sin.alias("month_sin"),
        month_cos.alias("month_cos"),
        M.grid_humidity("temperature_c", "dewpoint_c").alias("relative_humidity"),
        M.grid_wind_chill("temperature_c", "wind_speed_kt").alias("wind_chill"),
        M.visibility_category("visibility_m").alias("vis_category"),
        M.ceiling_category("ceiling_ft").alias("ceiling_category"),
        M.grid_severity("has_fog", "has_thunderstorm", "has_ice", "visibility_m", "ceiling_ft").alias(
            "weather_severity"
        ),
    )
    levels = on_steps.select(M.visibility_category("visibility_m").alias("vis_category"), M.ceiling_category("ceiling_ft").alias("ceiling_category"))
    return handle_missing(out, _modes(levels), strategy=strategy)


def _modes(levels: DataFrame) -> dict[str, str]:
    """Most frequent value of each column of a few levels, the smallest on a tie; one row per combination comes to the driver."""
    counts: dict[str, Counter] = {c: Counter() for c in levels.columns}
    for r in levels.groupBy(*levels.columns).agg(F.count(F.lit(1)).alias("_n")).collect():
        for c in levels.columns:
            counts[c][r[c]] += r["_n"]
    known = {c: sorted((-n, v) for v, n in own.items() if v is not None) for c, own in counts.items()}
    return {c: own[0][1] for c, own in known.items() if own}


def handle_missing(df: DataFrame, modes: dict[str, str], limit: int = 2, strategy: str = "auto") -> DataFrame:
    """Fill numbers forward then backward by at most `limit` rows, categories by their mode, the rest by 0."""
    numbers = numeric_columns(df, {"station"})
    filled = grid.fill_both_ways(df, limit, numbers, strategy=strategy)
    return prep.fill_zero(filled.fillna(modes) if modes else filled, numbers)


def sampling_summary(rows: DataFrame, windows: DataFrame, hours_added: float = 8.0) -> DataFrame:
    """Rows per label and window status, next to the number, length and weather share of the windows."""
    counts = rows.groupBy("has_regulation", "in_window").agg(F.count(F.lit(1)).alias("n"))
    one = windows.agg(
        F.count(F.lit(1)).alias("windows"),
        rnd(F.avg("duration_hours")).alias("mean_interval_hours"),
        rnd(F.avg(F.col("duration_hours") + F.lit(hours_added))).alias("mean_window_hours"),
        rnd(F.avg(is_weather_reason("reason").cast("int"))).alias("weather_share"),
    )
    return counts.join(F.broadcast(one), F.lit(True))  # four rows and one row


def scaled_blocks(reports: DataFrame) -> DataFrame:
    """Archive reports decoded into scaled numbers next to wind-quadrant and cloud-cover indicators."""
    fields = reports.select("event_id", "station", "ts", *T.legacy_fields("report"))
    filled = ordering.fill_series(fields, ["temperature_c", "dewpoint_c"])
    numbers = ["visibility_m", "ceiling_ft", "wind_speed_kt", "temperature_c", "dewpoint_c"]
    scaled = prep.Scaler("minmax").fit(filled, numbers).transform(filled)
    encoded = prep.wind_quadrants(scaled, "wind_direction_text", "wind")
    encoded = prep.one_hot(encoded, "ceiling_cover", "cover", values=range(5))
    return encoded.drop("wind_direction_text", "ceiling_cover")


BALANCED_FEATURES = [
    "visibility_m", "ceiling_ft", "wind_speed_kt", "wind_direction", "temperature_c", "dewpoint_c",
    "hour", "day_of_week", "month", "is_weekend",
    "low_visibility", "very_low_visibility", "low_ceiling", "very_low_ceiling", "high_wind", "very_high_wind",
    "temp_dewpoint_diff", "fog_risk", "wind_temp_interaction", "flight_category",
]


def balanced_dataset(observations: DataFrame, regulations: DataFrame) -> DataFrame:
    """Observations labelled around the intervals, balanced, with features and a split by time.

    All positives, as many negatives (70 % of them from the windows around intervals), a missing ceiling
    becomes the median, and the last 15 % of the rows in time are the test part.  Features that look
    ahead in time are left out.
    """
    windows = intervals.sampling_windows(filters.usable_intervals(regulations))
    labelled = settle(intervals.label_with_windows(observations, windows))
    rows = balance.balance_windows(labelled, "has_regulation", "in_window", ["event_id"])
    rows = settle(rows)
    made = prep.impute(rows, ["ceiling_ft"]).select(
        "*",
        D.hour("ts").alias("hour"),
        D.day_of_week("ts").alias("day_of_week"),
        F.month("ts").alias("month"),
        D.is_weekend("ts").alias("is_weekend"),
        *M.condition_flags("visibility_m", "ceiling_ft", "wind_speed_kt", "temperature_c", "dewpoint_c"),
        M.flight_category_code("visibility_m", "ceiling_ft").alias("flight_category"),
    )
    split = balance.chronological_split(made, [0.85, 0.82], ["train", "val", "test"])
    return split.select("event_id", "station", "ts", "has_regulation", *BALANCED_FEATURES, "split")


def balanced_models(rows: DataFrame, runs: dict[str, dict]) -> DataFrame:
    """Per model: the threshold of the best F1 on the validation part, and the metrics on the test part.

    The models are fitted at the same time, and each scores the two parts once.
    """
    label, rows = "has_regulation", settle(rows)
    train, rest = rows.where(F.col("split") == "train"), rows.where(F.col("split") != "train")
    weighted = balance.with_class_weight(train, label)

    def one(run: tuple[str, dict]) -> DataFrame:
        name, settings = run
        weight = {} if settings["kind"] == "neural_network" else {"weight": "weight"}
        model = models.fit(weighted, columns=BALANCED_FEATURES, label=label, **weight, **settings)
        scored = settle(models.score(model, rest).select(label, "split", "score"))
        val, test = [scored.where(F.col("split") == s).drop("split") for s in ("val", "test")]
        cut = metrics.best_threshold(val, label).first()
        threshold = float(cut["threshold"]) if cut else 0.5
        measured = models.evaluate(test, label, threshold)
        return measured.select(F.lit(name).alias("model"), F.lit(threshold).alias("threshold"), "accuracy", "precision", "recall", "f1", "auc")

    with ThreadPoolExecutor(min(len(runs), 4)) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, runs.items()))
