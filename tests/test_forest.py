"""The forest against Spark's own on held-out rows, its two ways of growing, and its storage."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from aerogrid.operators import models
from aerogrid.operators import forest
from aerogrid.operators.forest import BINS, Forest, ForestModel, best_splits, grow
from aerogrid.session import scratch_path

COLUMNS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def halves(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 4))
    p = 1 / (1 + np.exp(-3 * (x[:, 0] * x[:, 1] + np.sin(3 * x[:, 2]))))
    y = (rng.random(6000) < p).astype(int)
    rows = [(*map(float, v), int(t), i % 3) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    table = spark.createDataFrame(rows, "a double, b double, c double, d double, y int, part int").repartition(3).cache()
    return table.where("part > 0"), table.where("part = 0")


def area(scored):
    return BinaryClassificationEvaluator(labelCol="y").evaluate(scored)


def test_as_good_as_the_forest_of_spark(halves):
    train, test = halves
    own = Forest(columns=COLUMNS, labelCol="y", numTrees=60, maxDepth=12).fit(train)
    assembled = [VectorAssembler(inputCols=COLUMNS, outputCol="features").transform(x) for x in halves]
    other = RandomForestClassifier(labelCol="y", numTrees=60, maxDepth=12, minInstancesPerNode=2, featureSubsetStrategy="sqrt", seed=1).fit(assembled[0])
    assert area(own.transform(test)) > area(other.transform(assembled[1])) - 0.01
    assert abs(own.featureImportances.sum() - 1) < 1e-9 and own.featureImportances[3] == min(own.featureImportances)


def test_upper_levels_and_small_subtrees_make_the_same_kind_of_trees(halves):
    train, test = halves
    whole, cut = (Forest(columns=COLUMNS, labelCol="y", numTrees=30, maxDepth=10, smallRows=n).fit(train) for n in (200_000, 300))
    assert abs(area(whole.transform(test)) - area(cut.transform(test))) < 0.01
    again = Forest(columns=COLUMNS, labelCol="y", numTrees=30, maxDepth=10, smallRows=300).fit(train.repartition(1).repartition(3))
    assert abs(area(again.transform(test)) - area(cut.transform(test))) < 0.02


def test_trees_keep_to_their_settings(halves):
    train, _ = halves
    for small in (200_000, 500):
        model = Forest(columns=COLUMNS, labelCol="y", numTrees=4, maxDepth=3, minInstancesPerNode=40, smallRows=small).fit(train)
        parts, first = model.trees.parts, [*model.trees.first, len(model.trees.parts["feature"])]
        for a, b in zip(first, first[1:], strict=False):
            depth = {0: 0}
            for i in range(b - a):  # children come after their parent
                if parts["feature"][a + i] >= 0:
                    left = parts["left"][a + i]
                    depth[left] = depth[left + 1] = depth[i] + 1
            assert len(depth) == b - a and max(depth.values()) <= 3


def test_best_split_is_the_best_of_all(halves):
    rng = np.random.default_rng(0)
    bins, y, times = rng.integers(0, BINS, (50, 1)).astype(np.uint8), rng.integers(0, 2, 50).astype(float), rng.integers(0, 4, 50)
    tree = grow(bins, y, np.ones(50), times, 1, 2, 5, 1, rng)

    def impurity(mask):
        w, p = times[mask].sum(), (times * y)[mask].sum()
        return 2 * p * (w - p) / w if w else 0

    gains = {c: impurity(bins[:, 0] >= 0) - impurity(bins[:, 0] <= c) - impurity(bins[:, 0] > c) for c in range(BINS - 1) if min(times[bins[:, 0] <= c].sum(), times[bins[:, 0] > c].sum()) >= 2}
    assert abs(tree["gain"][0] - max(gains.values())) < 1e-5 and abs(gains[int(tree["bin"][0])] - max(gains.values())) < 1e-9
    assert best_splits(np.zeros((1, 1, BINS, 3)), 1)[2][0] <= 0


def test_stored_and_loaded(halves, spark):
    train, test = halves
    model = models.fit(train, "random_forest", COLUMNS, "y", numTrees=5, maxDepth=6)
    path = scratch_path(spark, "forest")
    models.save_package(model, path, COLUMNS, 0.4, spark)
    again, columns, threshold = models.load_package(path, spark)
    assert isinstance(again.stages[-1], ForestModel) and (columns, threshold) == (COLUMNS, 0.4)
    a, b = (sorted(r.score for r in models.score(m, test).select("score").collect()) for m in (model, again))
    assert a == b
    assert np.allclose(model.stages[-1].featureImportances, again.stages[-1].featureImportances)


def test_odd_rows(spark):
    rows = [(None, 1.0, 1), (float("nan"), 2.0, 0), (3.0, None, 1), (4.0, 4.0, None), (1.0, 1.0, 0), (1.0, 1.0, 0)] * 5
    table = spark.createDataFrame(rows, "a double, b double, y int").withColumn("_p", F.lit(1))
    model = Forest(columns=["a", "b"], labelCol="y", numTrees=3).fit(table)
    assert model.transform(table).count() == len(rows)
    for odd in (table.where("false"), table.where("y = 1"), table.limit(1)):
        alike = Forest(columns=["a", "b"], labelCol="y", numTrees=3).fit(odd).transform(table.limit(2))
        assert {r.p for r in alike.select(F.col("probability").cast("string").alias("p")).collect()}


@pytest.mark.parametrize("width", [3, 11])
def test_equal_rows_are_moved_as_one_and_grow_the_same_tree(width):
    rng = np.random.default_rng(3)
    bins = rng.integers(0, 3, (4000, width)).astype(np.uint8)
    bins[:, 3:] = 0
    y, w, row = (bins[:, 0] > rng.integers(0, 3, 4000)).astype(float), np.where(bins[:, 1] > 0, 0.5, 2.0), np.arange(4000)
    batch = forest.pa.RecordBatch.from_arrays([forest.pa.array(row), forest._packed_rows(bins), forest.pa.array(y), forest.pa.array(w)], ["row", "bins", "y", "w"])
    moved = [r for b in forest._moved({}, {}, range(2), width, 1)(iter([batch])) for r in b.to_pylist()]
    assert [len(r["times"]) // 8 for r in moved] == [27, 27]
    made = [b.to_pylist()[0] for b in forest._grown(width, 2, 4, 2, 5, 1)(forest.pa.RecordBatch.from_pylist([r]) for r in moved)]
    for r in made:
        alone = grow(bins, y, w, forest._times(row, r["tree"], 1), 4, 2, 5, 2, np.random.default_rng((1, r["tree"], 1)))
        assert np.frombuffer(r["feature"], np.int16).tolist() == alone["feature"].tolist() and np.frombuffer(r["bin"], np.uint8).tolist() == alone["bin"].tolist()
        trees = forest.Trees([alone])
        scored = forest._Scored(trees)
        for part in (bins[:0], bins[:100], bins[50:], bins):
            assert (scored.of(part) == trees.score(part)).all()


def test_many_rows_of_few_ranges_grow_whole_trees(spark, monkeypatch):
    """What a task holds are distinct rows of ranges: without more of them than `smallRows`, no pass over the rows adds up histograms."""
    table = spark.range(0, 2000, 1, 3).selectExpr("CAST(id % 5 AS DOUBLE) AS a", "CAST(id % 7 AS DOUBLE) AS b", "CAST(id % 3 = 0 OR id % 5 > 2 AS INT) AS y")
    monkeypatch.setattr(forest, "_histograms", None)
    cut, whole = (Forest(columns=["a", "b"], labelCol="y", numTrees=5, maxDepth=6, smallRows=n).fit(table) for n in (100, 200_000))
    assert all((cut.trees.parts[k] == whole.trees.parts[k]).all() for k in forest.Trees.NAMES) and (cut.trees.first == whole.trees.first).all()


def test_draws_are_the_shares_of_the_hash():
    rows = np.arange(100_000)
    for tree in range(3):
        assert (forest._times(rows, tree, 42) == np.searchsorted(forest.POISSON, forest._mixed(rows, 42 * 100_003 + tree) / 2.0**64)).all()
    near = np.array([int(x) + step for x in forest.DRAWS for step in (-1, 0, 1)], np.uint64)
    assert ((near[:, None] >= forest.DRAWS).sum(axis=1) == np.searchsorted(forest.POISSON, near / 2.0**64)).all()


def test_draws_are_added_up_by_cell_label_and_weight():
    rng = np.random.default_rng(3)
    cell, y, w, row = rng.integers(0, 20, 5000), rng.integers(0, 2, 5000).astype(float), rng.choice([0.5, 2.0], 5000), rng.permutation(5000)
    times = forest._times(row, 7, 42).astype(float)
    for got, x in zip(forest._Kinds(row, cell, 21, y, w).seen(7, 42), (times, times * w, times * w * y), strict=True):
        assert (got == np.bincount(cell, x, 21)).all()


def test_a_search_works_out_the_ranges_once(spark, monkeypatch):
    table = spark.range(0, 2000, 1, 3).selectExpr("CAST(id % 50 AS DOUBLE) AS a", "CAST(id % 7 AS DOUBLE) AS b", "CAST(id % 3 = 0 AS INT) AS y")
    made, cut = [], forest._with_bins
    monkeypatch.setattr(forest, "_with_bins", lambda *args: made.append(1) or cut(*args))
    one = Forest(columns=["a", "b"], labelCol="y", numTrees=4)
    maps = [{one.maxDepth: 3}, {one.maxDepth: 6, one.numTrees: 2}]
    together = dict(one.fitMultiple(table, maps))
    assert len(made) == 1
    for i, alone in enumerate(one.fit(table, m) for m in maps):
        assert all((together[i].trees.parts[k] == alone.trees.parts[k]).all() for k in forest.Trees.NAMES)
        assert together[i].getOrDefault("maxDepth") == alone.getOrDefault("maxDepth")
    dict(one.fitMultiple(table, [{one.labelCol: "b"}, {one.labelCol: "y"}]))
    assert len(made) == 5  # other labels are other rows


def test_one_feature_is_scored(halves):
    train, test = halves
    model = Forest(columns=["c"], labelCol="y", numTrees=10, maxDepth=6).fit(train)
    assert area(model.transform(test)) > 0.6


def test_elimination_comes_down_to_the_one_feature_that_tells(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(a), float(b), int(a > 0)) for i, (a, b) in enumerate(rng.normal(size=(600, 2)))]
    table = spark.createDataFrame(rows, "id long, a double, b double, y int")
    left = models.eliminate_by_validation(table, ["a", "b"], "y", ["id"], numTrees=10, maxDepth=3)
    assert "a" in left
    aucs = models.cross_validate(table, "random_forest", ["a"], "y", ["id"], 3, numTrees=10, maxDepth=3)
    assert min(r["auc"] for r in aucs.collect()) > 0.95
