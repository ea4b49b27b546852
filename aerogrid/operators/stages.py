"""Preprocessing as Spark ML stages, so a whole preparation can be fitted, saved, loaded and replayed.

`Step` (an estimator) learns a small state with a function of `FITS`; `FittedStep` applies it with a
function of `APPLIES`.  Both keep settings and state as JSON params, which is all that is stored.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerogrid.functions import timefeat, weather
from aerogrid.functions.num import categorical_columns, numeric_columns
from aerogrid.operators import filters, joins, ordering, prep, reduction, selection, windows
from aerogrid.session import settle, settle_by_column

KEYS = ("station", "ts", "event_id")

# The preset for weather tables.
WEATHER_CYCLES = {"hour": 24, "day_of_week": 7, "month": 12}
WEATHER_LAGS = {
    "temperature_c": [1, 3, 6, 12, 24],
    "wind_speed_kt": [1, 3, 6, 12],
    "visibility_m": [1, 3, 6],
    "pressure_hpa": [1, 3, 6, 12, 24],
}
SMOOTHING = 10.0  # rows of the mean that each category is thought to have besides its own
HIGH_CARDINALITY = ("airport", "station", "city", "country")


class _Stored(Params):
    kind = Param(Params._dummy(), "kind", "which preparation step this is", TypeConverters.toString)
    state = Param(Params._dummy(), "state", "settings or fitted state as JSON", TypeConverters.toString)

    def value(self) -> dict:
        return json.loads(self.getOrDefault(self.state))


class Step(Estimator, _Stored, DefaultParamsReadable, DefaultParamsWritable):
    """A preparation step before fitting."""

    @keyword_only
    def __init__(self, *, kind: str | None = None, state: str | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> FittedStep | FittedEncoding:
        name = self.getOrDefault(self.kind)
        if name == "encode":
            return _fit_encode(dataset, self.value())
        learned = FITS[name](dataset, self.value()) if name in FITS else self.value()
        return FittedStep(kind=name, state=json.dumps(learned))


class FittedStep(Model, _Stored, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted preparation step."""

    @keyword_only
    def __init__(self, *, kind: str | None = None, state: str | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return APPLIES[self.getOrDefault(self.kind)](dataset, self.value())


class FittedEncoding(Model, _Stored, MLWritable, MLReadable):
    """A fitted encoding.  Its tables of categories are data of their own: joined when applied, stored as Parquet, never on the driver."""

    tables: dict[str, DataFrame]

    @keyword_only
    def __init__(self, *, kind: str | None = None, state: str | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        s, out = self.value(), dataset
        for c, values in s["one_hot"].items():
            out = prep.one_hot(out, c, c, values, drop_first=True).drop(c)
        for c in s["target"]:
            table = self.tables[c].select(F.col("category").alias("_k"), F.col("value").alias("_v"))
            out = out.join(joins.broadcast_if_small(table), out[c] == F.col("_k"), "left")
            out = out.withColumn(f"{c}_encoded", F.coalesce("_v", F.lit(s["prior"]))).drop("_k", "_v")
            out = out if c in KEYS else out.drop(c)
        return out

    def write(self) -> MLWriter:
        return _EncodingWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _EncodingReader(cls)


class _EncodingWriter(MLWriter):
    def __init__(self, model: FittedEncoding):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        for i, c in enumerate(self.model.value()["target"]):
            self.model.tables[c].write.parquet(f"{path}/categories/{i}")


class _EncodingReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> FittedEncoding:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls()
        DefaultParamsReader.getAndSetParams(model, metadata)
        model._resetUid(metadata["uid"])
        model.tables = {c: self.sparkSession.read.parquet(f"{path}/categories/{i}") for i, c in enumerate(model.value()["target"])}
        return model


def step(kind: str, **settings) -> Step:
    return Step(kind=kind, state=json.dumps(settings))


def _numbers(df: DataFrame, settings: dict) -> list[str]:
    names = settings.get("columns")
    skip = set(KEYS) | set(settings.get("skip", []))
    return [c for c in (names or numeric_columns(df)) if c in df.columns and c not in skip]


# ---------------------------------------------------------------- what each step learns


def _fit_impute(df, s):
    cats = [c for c in s.get("categorical", []) if c in df.columns]
    fills = {c: m for c, m in prep.medians(df, _numbers(df, s)).items() if m is not None}
    for c in cats:
        top = prep.most_frequent(df, c)
        if top is not None:
            fills[c] = top
    return {"fills": fills}


def _fit_outliers(df, s):
    found = prep.OutlierBounds(s["method"], s["threshold"], "clip").fit(df, _numbers(df, s))
    return {"bounds": found.bounds}


def _fit_encode(df, s) -> FittedEncoding:
    """Indicators for columns of few values; for the others a table (category, value), kept beside the stage."""
    state, tables = {"one_hot": {}, "target": [], "prior": 0.0, "label": s["label"]}, {}
    label = F.col(s["label"]).cast("double")
    known = df.agg(F.avg(label)).first()[0]
    state["prior"] = prior = float(known or 0.0)
    for c in s["columns"]:
        if c in HIGH_CARDINALITY:
            rows = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("category")).agg(F.sum(label).alias("t"), F.count(label).alias("n"))
            value = (F.coalesce("t", F.lit(0.0)) + F.lit(SMOOTHING * prior)) / (F.col("n") + F.lit(SMOOTHING))
            tables[c] = settle(rows.select("category", value.alias("value")))
            state["target"].append(c)
        else:
            state["one_hot"][c] = prep.distinct_values(df, c)
    model = FittedEncoding(kind="encode", state=json.dumps(state))
    model.tables = tables
    return model


def _fit_scale(df, s):
    names = _numbers(df, s)
    if s["method"] == "time_series":
        raise ValueError("block scaling keeps a table per block; use prep.BlockScaler")
    found = prep.Scaler(s["method"]).fit(df, names)
    return {"centre": found.centre, "scale": found.scale}


def _fit_bins(df, s):
    return {"edges": prep.QuantileBins(s["bins"]).fit(df, _numbers(df, s)).edges, "indicators": s["indicators"]}


def _fit_reduce(df, s):
    names = _numbers(df, s)
    if s["method"] == "truncated_svd":
        return {"method": "linear", **reduction.fit_svd(df, names, 50)}
    if s["method"] == "nmf":
        return {"method": "nmf", **reduction.fit_nmf(df, names, 30)}
    return {"method": "linear", **reduction.fit_pca(df, names, 0.95)}


def _fit_select(df, s):
    names = _numbers(df, {**s, "skip": [s["label"]]})
    method, label = s["method"], s["label"]
    if method in ("mutual_info", "f_score", "f_classif", "chi2"):
        scorer = {"mutual_info": selection.mutual_information, "chi2": selection.chi2_scores}.get(method, selection.anova_f)
        table = selection.select_best(scorer(df, names, label), s.get("k"), s.get("share", 0.8))
        kept = {r["feature"] for r in table.collect()}
    else:
        from aerogrid.operators import models

        if method == "lasso":
            kept = set(models.lasso_features(df, names, label))
        elif method == "rfe":
            kept = set(models.eliminate_features(df, names, label, s.get("k") or max(1, len(names) // 2), **s.get("model", {})))
        else:
            kept = set(models.important_features(df, names, label, **s.get("model", {})))
    return {"kept": [c for c in names if c in kept], "label": label}


def _fit_fill(df, s):
    names = _numbers(df, s)
    flowing = [c for c in names if any(p in c for p in ("lag_", "roll_", "diff"))]
    filled = settle_by_column(ordering.fill_series(df, flowing).select(*names), "filled") if flowing else df  # read by five passes
    shares = filters.missing_shares(filled, names)
    known = [c for c in names if shares[c] < 1.0]
    return {"flowing": flowing, "medians": prep.medians(filled, known), "dropped": [c for c in names if shares[c] == 1.0]}


FITS = {
    "impute": _fit_impute,
    "outliers": _fit_outliers,
    "scale": _fit_scale,
    "bins": _fit_bins,
    "reduce": _fit_reduce,
    "select": _fit_select,
    "fill": _fit_fill,
}


# ---------------------------------------------------------------- what each step does


def _apply_lags(df, s):
    lags = {c: k for c, k in s["lags"].items() if c in df.columns}
    if not lags:
        return df
    back = max([k for ks in lags.values() for k in ks] + list(s.get("windows", [])))

    def build(w):
        made = []
        for c, ks in lags.items():
            made += windows.lag_columns(w, [c], ks)
            made += windows.rolling_columns(w, [c], s.get("windows", []), s.get("stats", ["mean", "std", "min", "max"]))
        return made

    return ordering.over_series(df, build, back=back)


def _apply_transform(df, s):
    names = _numbers(df, s)
    if s["method"] == "polynomial":
        return prep.polynomial(df, names)
    return df.withColumns({c: F.log1p(F.abs(F.col(c))) for c in names})


def _apply_weather(df, s):
    """Derivatives, interactions and domain features of the weather columns that exist."""
    have = set(df.columns)
    t, dew, p, v = "temperature_c", "dewpoint_c", "pressure_hpa", "wind_speed_kt"
    vis, ceil, gust, dirn = "visibility_m", "ceiling_ft", "wind_gust_kt", "wind_direction"
    changing = [c for c in (t, p, v, vis) if c in have]
    out = windows.with_derivatives(df, changing) if changing else df
    if p in have:
        out = windows.with_pressure_tendency(out, p)
    made = {}
    if {t, dew} <= have:
        made["relative_humidity"] = weather.report_humidity(t, dew)
        made["temp_dewpoint_spread"] = F.col(t) - F.col(dew)
    if {t, v} <= have:
        made["wind_chill"] = weather.report_wind_chill(t, v)
    if vis in have:
        made["visibility_cat"] = weather.visibility_category(vis)
    if {v, gust} <= have:
        made["gust_factor"] = weather.gust_factor(gust, v)
        made["turbulence"] = weather.turbulence(gust, v)
    if {ceil, vis} <= have:
        made["ceiling_visibility_product"] = F.col(ceil) * F.col(vis)
        made["flight_category"] = weather.flight_category(ceil, vis)
    if {dirn, v} <= have:
        for bearing in (90, 270):
            made[f"crosswind_rwy_{bearing}"] = weather.crosswind(dirn, v, bearing)
            made[f"headwind_rwy_{bearing}"] = weather.headwind(dirn, v, bearing)
    if {vis, ceil, v} <= have:
        made["weather_severity"] = weather.report_severity(vis, ceil, v)
    return out.withColumns(made) if made else out


def _apply_series(df, s):
    """Lags, lag differences, rolling statistics and calendar columns."""
    names = [c for c in s["columns"] if c in df.columns]
    stats = ["mean", "std", "min", "max", "skew", "kurt", "trend", "zscore"]
    back = max(max(s["lags"]), max(s["windows"]) - 1)
    out = ordering.over_series(
        df,
        lambda w: windows.lag_columns(w, names, s["lags"], True) + windows.rolling_columns(w, names, s["windows"], stats),
        back=back,
    )
    if s.get("seasonal"):
        for c in [c for c in ("temperature_c", "pressure_hpa", "wind_speed_kt") if c in names]:
            parts = windows.seasonal_decompose(df, c).drop(c, "ts")
            out = out.join(parts, ["station", "event_id"])
    return out.select("*", *timefeat.calendar_columns("ts"))


def _apply_statistics(df, s):
    """Powers, roots and logarithms of the main variables, and row statistics."""
    made = {}
    for c in [c for c in ("temperature_c", "pressure_hpa", "wind_speed_kt") if c in df.columns]:
        for degree in range(2, s.get("degree", 2) + 1):
            made[f"{c}_pow_{degree}"] = F.pow(F.col(c), F.lit(float(degree)))
        made[f"{c}_sqrt"] = F.sqrt(F.abs(F.col(c)))
        made[f"{c}_log"] = F.log1p(F.abs(F.col(c)))
    out = df.withColumns(made) if made else df
    return prep.row_statistics(out, [c for c in numeric_columns(out) if c not in KEYS])


def _apply_fill(df, s):
    flowing = [c for c in s["flowing"] if c in df.columns]
    out = ordering.fill_series(df, flowing) if flowing else df
    medians = {c: m for c, m in s["medians"].items() if m is not None and c in df.columns}
    return (out.fillna(medians) if medians else out).drop(*s["dropped"])


def _bins(df, s):
    fitted = prep.QuantileBins()
    fitted.edges = s["edges"]
    return fitted.transform(df, s["indicators"])


def _select(df, s):
    return df.select(*[c for c in df.columns if c in s["kept"] or c in KEYS or c == s["label"]])


APPLIES = {
    "impute": lambda df, s: df.fillna(s["fills"]) if s["fills"] else df,
    "outliers": lambda df, s: prep.OutlierBounds(bounds={c: tuple(b) for c, b in s["bounds"].items()}).transform(df),
    "lags": _apply_lags,
    "cyclical": lambda df, s: timefeat.encode_cyclical(df, {c: p for c, p in s["periods"].items() if c in df.columns}),
    "scale": lambda df, s: prep.Scaler("standard", s["centre"], s["scale"]).transform(df),
    "transform": _apply_transform,
    "bins": _bins,
    "reduce": lambda df, s: reduction.apply_nmf(df, s) if s["method"] == "nmf" else reduction.project(df, s),
    "select": _select,
    "weather": _apply_weather,
    "series": _apply_series,
    "statistics": _apply_statistics,
    "fill": _apply_fill,
    "settle": lambda df, s: settle(df),
}


# ---------------------------------------------------------------- named preparations


def preparation(
    numerical: Sequence[str],
    categorical: Sequence[str] = (),
    cyclical: dict[str, float] | None = None,
    lags: dict[str, Sequence[int]] | None = None,
    label: str = "y",
    impute: bool = True,
    outliers: str | None = "iqr",
    threshold: float = 1.5,
    scaling: str | None = "standard",
    transform: str | None = None,
    reduce: str | None = None,
    select: str | None = None,
    share: float = 0.8,
) -> Pipeline:
    """The nine preparation steps in their fixed order; each can be switched off."""
    numerical, categorical = list(numerical), list(categorical)
    steps = []
    if impute:
        steps.append(step("impute", columns=numerical, categorical=categorical))
    if outliers:
        steps.append(step("outliers", columns=numerical, method=outliers, threshold=threshold))
    if lags:
        steps.append(step("lags", lags={c: list(k) for c, k in lags.items()}, windows=[3, 6, 12, 24]))
    if cyclical:
        steps.append(step("cyclical", periods=cyclical))
    if categorical:
        steps.append(step("encode", columns=categorical, label=label))
    if scaling:
        steps.append(step("scale", columns=numerical, method=scaling))
    if transform:
        steps.append(step("transform", columns=numerical, method=transform))
    if reduce:
        steps.append(step("reduce", columns=numerical, method=reduce))
    if select:
        steps.append(step("select", method=select, share=share, label=label))
    return Pipeline(stages=steps)


def fit_transform(flow: Pipeline, df: DataFrame) -> tuple[PipelineModel, DataFrame]:
    """Fit a preparation and return it with the prepared table, running each step once."""
    fitted = []
    for stage in flow.getStages():
        model = stage.fit(df) if isinstance(stage, Estimator) else stage
        df = model.transform(df)
        fitted.append(model)
    return PipelineModel(fitted), df


def weather_preparation(df: DataFrame, label: str = "y", **kw) -> Pipeline:
    """Preparation with detected column types and the weather presets."""
    skip = {label, *KEYS}
    cycles = {c: p for c, p in WEATHER_CYCLES.items() if c in df.columns}
    lags = {c: k for c, k in WEATHER_LAGS.items() if c in df.columns}
    numbers = [c for c in numeric_columns(df, skip) if c not in cycles]
    return preparation(numbers, categorical_columns(df, skip), cycles, lags, label, **kw)


def engineered(columns: Sequence[str], label: str, k: int | None = None, method: str = "mutual_info") -> Pipeline:
    """Weather, series and statistical features, the fill rules, sparse columns dropped, then selection."""
    return Pipeline(
        stages=[
            step("weather"),
            step("series", columns=list(columns), lags=[1, 3, 6, 12, 24], windows=[6, 12, 24], seasonal=True),
            step("statistics", degree=2),
            step("settle"),  # what follows reads the features several times
            step("bins", columns=list(columns), bins=5, indicators=True),
            step("fill", skip=[label]),
            step("settle"),
            step("select", method=method, k=k, share=1.0, label=label),
        ]
    )


def recipe(model: str, columns: Sequence[str], label: str) -> Pipeline:
    """Preparation suited to a kind of model: sequence, tree or linear."""
    if model in ("lstm", "gru", "rnn", "cnn"):
        return Pipeline(stages=[step("series", columns=list(columns), lags=[1, 2, 3, 6, 12], windows=[3, 6, 12])])
    if model in ("random_forest", "xgboost"):
        return engineered(columns, label, method="random_forest")
    return Pipeline(stages=[step("statistics", degree=2)])
