"""Models, detectors, reductions and preparation stages."""

import threading

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from aerogrid.operators import detectors, models, prep, reduction, selection, stages, summaries
from aerogrid.plans import facades
from aerogrid.session import scratch_path
from aerogrid.sources import standins as S

COLS = ["x0", "x1", "x2"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(400, 3))
    rows = [(i, *map(float, r), int(r[0] + r[1] > 0)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, x0 double, x1 double, x2 double, y int")


@pytest.mark.parametrize(
    "kind, kw",
    [
        ("random_forest", {"numTrees": 10, "maxDepth": 4}),
        ("gradient_boosting", {"maxIter": 5, "maxDepth": 3}),
        ("logistic_regression", {"maxIter": 20}),
        ("neural_network", {"hidden": [4], "maxIter": 30}),
    ],
)
def test_separable_data(table, kind, kw):
    model = models.fit(table, kind, COLS, "y", **kw)
    assert models.evaluate(models.score(model, table), "y").first()["auc"] > 0.9


def test_package_round_trip(spark, table):
    model = models.fit(table, "logistic_regression", COLS, "y", maxIter=20)
    path = scratch_path(spark, "package")
    models.save_package(model, path, COLS, 0.3, spark)
    scored = models.score_package(table, path).collect()
    assert all(r["prediction"] == (r["score"] >= 0.3) for r in scored)
    assert models.load_package(path, spark)[1:] == (COLS, 0.3)


def test_stored_stack_replays(spark, table):
    train, rest = table.randomSplit([0.5, 0.5], 3)
    train, rest = train.cache(), rest.cache()
    paths = []
    for name, kw in {"forest": {"kind": "random_forest", "numTrees": 10, "maxDepth": 4}, "linear": {"kind": "logistic_regression"}}.items():
        paths.append(scratch_path(spark, name))
        models.save_package(models.fit(train, columns=COLS, label="y", **kw), paths[-1], COLS, 0.5, spark)
    path = scratch_path(spark, "stack")
    models.save_stack(rest, paths, "y", path)
    first, again = (sorted(map(tuple, models.score_stack(rest, path).select("y", "score", "prediction").collect())) for _ in range(2))
    assert first == again and np.mean([y == p for y, _, p in first]) > 0.9
    # the same by hand: score with each package, then with the stored meta-learner
    by_hand = models.score(models.load_package(paths[1], spark)[0], models.score(models.load_package(paths[0], spark)[0], rest, "base_0"), "base_1")
    meta, columns, _ = models.load_package(path, spark)
    assert columns == ["base_0", "base_1"]
    assert sorted(r.score for r in models.score(meta, by_hand).select("score").collect()) == sorted(s for _, s, _ in first)
    with pytest.raises(ValueError):
        models.save_stack(rest, paths[:1], "y", path)


def test_importances_and_elimination(spark, table):
    model = models.fit(table, "random_forest", COLS, "y", numTrees=10, maxDepth=4)
    ranked = [r["feature"] for r in models.importances(model, COLS, spark).collect()]
    assert ranked[-1] == "x2"
    assert models.eliminate_features(table, COLS, "y", 2, numTrees=10, maxDepth=4) == ["x0", "x1"]
    moved = {r["slot"]: r["importance"] for r in models.perturbation_importance(model, table, COLS).collect()}
    assert moved[0] > moved[2] and moved[1] > moved[2]


def test_failed_runs_are_rows(table):
    got = models.train_many(
        table, table, {"ok": {"kind": "logistic_regression"}, "bad": {"kind": "logistic_regression", "maxIter": -1}}, COLS, "y"
    )
    by = {r["model"]: r for r in got.collect()}
    assert by["ok"]["error"] is None and by["bad"]["error"] is not None and by["bad"]["f1"] is None


def test_detectors_find_an_outlier(spark, table):
    odd = spark.createDataFrame([(9999, 25.0, -25.0, 25.0, 0)], table.schema)
    rows = table.unionByName(odd)
    forest = detectors.fit_isolation_forest(rows, COLS, "id", trees=20, sample=64)
    top = detectors.isolation_scores(rows, COLS, forest).orderBy(F.desc("score")).first()
    far = detectors.robust_distance(rows, COLS).orderBy(F.desc("distance")).first()
    lone = detectors.local_outlier_scores(rows, COLS, 10).orderBy(F.desc("score")).first()
    assert top["id"] == far["id"] == lone["id"] == 9999


def test_reductions(table):
    state = reduction.fit_pca(table, COLS, 1.0)
    back = reduction.reconstruction_error(table, state).agg(F.max("error")).first()[0]
    assert back < 1e-18
    svd = reduction.fit_svd(table, COLS, 3)
    x = np.array([[r[c] for c in COLS] for r in table.collect()])
    assert np.allclose(svd["singular_values"], np.linalg.svd(x, compute_uv=False))
    positive = table.select("id", *[F.abs(c).alias(c) for c in COLS])
    fitted = reduction.fit_nmf(positive, COLS, 3, iterations=15)
    parts = reduction.apply_nmf(positive, fitted).collect()
    w = np.array([[r[f"nmf_{i}"] for i in range(3)] for r in parts])
    rebuilt = w @ np.array(fitted["factor"]) * np.array(fitted["scale"])
    assert (w >= 0).all() and np.abs(rebuilt - np.abs(x)).mean() < np.abs(x).mean() / 3


def test_variance_inflation(spark, table):
    x = np.array([[r[c] for c in COLS] for r in table.collect()])
    gram = x.T @ x
    wanted = dict(zip(COLS, np.diag(gram) * np.diag(np.linalg.inv(gram))))
    got = {r["feature"]: r["vif"] for r in selection.variance_inflation(table, COLS).collect()}
    assert got == pytest.approx(wanted)


def test_preparation_saves_and_replays(spark, table):
    dirty = table.withColumn("x1", F.when(F.col("id") % 9 != 0, F.col("x1"))).withColumn(
        "kind", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise("c")
    )
    flow = stages.preparation(COLS, ["kind"], label="y", select="f_score", share=0.6)
    fitted, made = stages.fit_transform(flow, dirty)
    path = scratch_path(spark, "stages")
    fitted.write().overwrite().save(path)
    again = PipelineModel.load(path).transform(dirty)
    assert again.columns == made.columns and "kind" not in made.columns
    assert again.exceptAll(made).count() == 0 and made.count() == 400


def test_scaler_round_trip(table):
    for method in ("standard", "minmax", "robust", "maxabs"):
        s = prep.Scaler(method).fit(table, COLS)
        worst = (
            s.inverse(s.transform(table))
            .join(table.select("id", *[F.col(c).alias(f"o_{c}") for c in COLS]), "id")
            .agg(F.max(F.greatest(*[F.abs(F.col(c) - F.col(f"o_{c}")) for c in COLS])))
            .first()[0]
        )
        assert worst < 1e-9


@pytest.mark.parametrize("rows", [1_500, 6_000])
def test_robust_centre_is_not_moved_by_outliers(spark, rows):
    """20 % of the rows stand together far away; the centre and the spread stay those of the others."""
    rng = np.random.default_rng(6)
    clean = rng.multivariate_normal([1.0, -2.0, 0.5], [[2.0, 0.8, 0.0], [0.8, 1.0, 0.2], [0.0, 0.2, 0.5]], rows * 4 // 5)
    x = np.concatenate([clean, rng.normal([9.0, 9.0, -9.0], 0.3, (rows // 5, 3)), [[np.nan, 0.0, 0.0]]])
    table = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "id long, x0 double, x1 double, x2 double")
    got = {r["id"]: r["distance"] for r in detectors.robust_distance(table, COLS).collect()}
    off = clean - clean.mean(axis=0)
    want = ((off @ np.linalg.inv(np.cov(off.T))) * off).sum(axis=1)
    ratio = np.array([got[i] for i in range(len(clean))]) / want
    assert 0.85 < np.median(ratio) < 1.2 and got[len(x) - 1] is None
    assert min(got[i] for i in range(len(clean), len(x) - 1)) > np.quantile(want, 0.999)
    assert detectors.robust_distance(table.where("false"), COLS).collect() == []


def plain_outlier_factors(x, k):
    """Local outlier factors by all distances; rows as far as the k-th nearest are neighbours too."""
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    apart = np.zeros((len(x), len(x)))
    for i in range(x.shape[1]):
        apart += (x[:, i, None] - x[None, :, i]) ** 2
    apart = np.sqrt(apart)
    np.fill_diagonal(apart, np.inf)
    kd = np.sort(apart, axis=1)[:, k - 1]
    near = apart <= kd[:, None]
    reach = np.where(near, np.maximum(apart, kd[None, :]), 0.0).sum(axis=1) / near.sum(axis=1)
    density = 1.0 / (reach + 1e-10)
    return (near * density[None, :]).sum(axis=1) / near.sum(axis=1) / density


def test_local_density_is_exact_across_cells(spark):
    """2,000 rows in cells of 50, some of them copies and one far away, against all distances."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(1500, 3)), rng.normal(size=(400, 3)) * 0.2 + 4, np.repeat(rng.normal(size=(3, 3)), 33, axis=0), [[25.0, -25.0, 25.0]]])
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, x0 double, x1 double, x2 double")
    want = plain_outlier_factors(x, 10)
    for cell_rows in (50, 2_000):
        got = {r["id"]: r["score"] for r in detectors.local_outlier_scores(rows, COLS, 10, cell_rows=cell_rows).collect()}
        assert len(got) == len(x) and max(abs(got[i] / want[i] - 1) for i in range(len(x))) < 1e-6
    assert got[len(x) - 1] > 5


def test_neighbours_are_all_found(spark):
    """The recall of the neighbours is 1, also where cells have fewer rows than k and coordinates tie."""
    rng = np.random.default_rng(8)
    x = np.unique(rng.integers(0, 12, (900, 2)).astype(float) * rng.choice([1.0, 1.0, 7.0], (900, 1)), axis=0)
    points = spark.createDataFrame([(i, int(m), *map(float, r)) for i, (r, m) in enumerate(zip(x, rng.integers(1, 4, len(x))))], "_id long, _m long, a double, b double")
    weight = np.array([r["_m"] for r in points.orderBy("_id").collect()])
    found = {r["_id"]: r for r in detectors.nearest_rows(points, ["a", "b"], 15, cell_rows=6).collect()}
    for i in range(len(x)):
        d = np.sqrt((x[i, 0] - x[:, 0]) ** 2 + (x[i, 1] - x[:, 1]) ** 2)
        own = weight - (np.arange(len(x)) == i)
        order = np.argsort(d, kind="stable")
        kd = d[order][np.searchsorted(np.cumsum(own[order]), 15)]
        assert found[i]["kd"] == kd
        assert {n["q"]: n["w"] for n in found[i]["near"]} == {int(q): int(own[q]) for q in np.flatnonzero((d <= kd) & (own > 0))}


def test_local_density_of_few_or_equal_rows(spark):
    few = spark.createDataFrame([(i, float(i // 2), None) for i in range(5)], "id long, x0 double, x1 double")
    assert all(np.isfinite(r["score"]) for r in detectors.local_outlier_scores(few, ["x0", "x1"], 20).collect())
    same = spark.range(60).selectExpr("id", "1.0D AS x0", "2.0D AS x1")
    assert {round(r["score"], 6) for r in detectors.local_outlier_scores(same, ["x0", "x1"], 5).collect()} == {1.0}
    assert {r["score"] for r in detectors.local_outlier_scores(same.limit(1), ["x0", "x1"], 5).collect()} == {1.0}
    assert detectors.local_outlier_scores(same.limit(0), ["x0", "x1"], 5).collect() == []


def test_sampling_share_of_very_large_tables():
    low, high = -(1 << 63), (1 << 63) - 1
    assert detectors.sample_limit(100, 256) == high
    for rows in (10**6, 10**9, 10**12, 10**15):
        expected = (detectors.sample_limit(rows, 256) - low) / 2**64 * rows
        assert 500 < expected < 524


def test_many_categories(spark):
    rows = spark.range(3_000).selectExpr("id", "concat('c', id % 1500) AS station", "CAST(id % 2 AS INT) AS y")
    assert len(prep.one_hot(rows, "station", "s").columns) == 1_503
    vectors = prep.one_hot_vector(rows, "station", "v").select("v").limit(5).collect()
    assert all(r["v"].size == 1_500 and len(r["v"].indices) == 1 for r in vectors)
    flow = stages.Pipeline(stages=[stages.step("encode", columns=["station"], label="y")])
    fitted = flow.fit(rows)
    assert fitted.stages[0].tables["station"].count() == 1_500 and "c77" not in fitted.stages[0].getOrDefault("state")
    path = scratch_path(spark, "encoding")
    fitted.write().overwrite().save(path)
    new = rows.withColumn("station", F.when(F.col("id") > 0, F.col("station")))
    encoded, again = fitted.transform(new), PipelineModel.load(path).transform(new)
    assert encoded.count() == 3_000 and encoded.where("station_encoded IS NULL").count() == 0
    assert encoded.exceptAll(again).count() == 0
    got = {r["station"]: r["station_encoded"] for r in encoded.collect()}
    assert abs(got["c7"] - (2 + 10 * 0.5) / 12) < 1e-12 and abs(got[None] - 0.5) < 1e-12


def test_vectors_of_many_categories_stay_sparse(spark):
    """Places and size come from the sparse form: 5,000 rows of 5,000 categories never become 25 million numbers."""
    rows = spark.range(5_000).selectExpr("id", "concat('c', lpad(id, 5, '0')) AS station").unionByName(spark.createDataFrame([(-1, None)], "id long, station string"))
    for drop, size in ((False, 5_000), (True, 4_999)):
        got = prep.one_hot_vector(rows, "station", "v", drop_first=drop).select("id", prep.vector_place("v").alias("v")).select("id", "v.place", "v.size")
        wrong = got.where((F.col("size") != size) | (F.col("place") != F.greatest(F.col("id") - int(drop), F.lit(-1))))
        assert wrong.count() == 0 and got.count() == 5_001
    few = spark.createDataFrame([("b",), ("a",), (None,)], "station string")
    for table, drop, sizes in ((few, False, [(0, 2), (1, 2), (-1, 2)]), (few, True, [(-1, 1), (0, 1), (-1, 1)]), (few.where("station = 'a'"), False, [(0, 1)])):
        placed = prep.one_hot_vector(table, "station", "v", drop_first=drop).select("station", prep.vector_place("v").alias("v"))
        assert [tuple(r["v"]) for r in placed.orderBy(F.asc_nulls_last("station")).collect()] == sizes


def test_a_million_categories_are_joined(spark, monkeypatch):
    """Beyond the broadcast limit the table is joined by a shuffle, and nothing of it is in the stage."""
    from aerogrid.operators import joins

    monkeypatch.setattr(joins.broadcast_if_small, "__defaults__", (1 << 16,))
    rows = spark.range(1_000_000).selectExpr("concat('k', id) AS station", "CAST(id % 3 = 0 AS INT) AS y")
    fitted = stages.step("encode", columns=["station"], label="y").fit(rows)
    hot = rows.limit(10).unionByName(spark.range(20_000).selectExpr("'k3' AS station", "0 AS y"))
    out = fitted.transform(hot)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 20_010 and len(fitted.getOrDefault("state")) < 200
    assert out.where("station = 'k3'").select("station_encoded").distinct().count() == 1


def test_content_hash_sees_pairs_and_nulls(spark):
    tables = [[(1, 1), (1, 1)], [(2, 2), (2, 2)], [(1, None)], [(None, 1)], [(1, 1)]]
    hashes = [tuple(summaries.content_hash(spark.createDataFrame(t, "a int, b int")).first()) for t in tables]
    assert len(set(hashes)) == len(tables)
    assert hashes[0] == tuple(summaries.content_hash(spark.createDataFrame(tables[0], "a int, b int").repartition(3)).first())


def test_balanced_flow(spark, sf_dir):
    rows = facades.balanced_dataset(S.observations(spark, sf_dir), S.intervals(spark, sf_dir))
    runs = {"forest": {"kind": "random_forest", "numTrees": 10, "maxDepth": 4}, "linear": {"kind": "logistic_regression"}}
    got = {r["model"]: r for r in facades.balanced_models(rows, runs).collect()}
    assert set(got) == set(runs)
    for r in got.values():
        assert 0 <= r["threshold"] <= 1 and all(0 <= r[m] <= 1 for m in ("accuracy", "precision", "recall", "f1", "auc") if r[m] is not None)


def test_balanced_models_are_fitted_at_the_same_time(spark, sf_dir, monkeypatch):
    rows = facades.balanced_dataset(S.observations(spark, sf_dir), S.intervals(spark, sf_dir))
    met, fit = threading.Barrier(2, timeout=60), models.fit
    monkeypatch.setattr(models, "fit", lambda *a, **kw: met.wait() is not None and fit(*a, **kw))
    runs = {"a": {"kind": "logistic_regression", "maxIter": 3}, "b": {"kind": "logistic_regression", "maxIter": 3}}
    a, b = facades.balanced_models(rows, runs).collect()
    assert (a["model"], b["model"]) == ("a", "b") and a[1:] == b[1:]
