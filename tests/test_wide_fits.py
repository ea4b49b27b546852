"""Fits that read their rows often: dealt over the cores, and worked out once."""

import pytest
from pyspark.sql import functions as F

from aerogrid import session
from aerogrid.operators import filters, forest, models, ordering, stages
from aerogrid.plans.catalog import all_queries
from tests.helpers import rows_of


def test_rows_of_few_parts_are_dealt_over_the_cores(spark, monkeypatch):
    monkeypatch.setattr(models, "SPREAD_ROWS", 100)
    one = spark.range(0, 1000, 1, 1).select("id", (F.col("id") % 2).alias("y"))
    dealt = models._spread(one, ["id", "y"])
    cores = spark.sparkContext.defaultParallelism
    assert dealt.rdd.getNumPartitions() == cores and sorted(dealt.collect()) == sorted(one.collect())
    assert max(r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()) <= 2 * 1000 / cores
    assert models._spread(dealt, ["id", "y"]) is dealt
    monkeypatch.setattr(models, "SPREAD_ROWS", 2000)
    assert models._spread(one, ["id", "y"]) is one


@pytest.mark.parametrize("kind", ["neural_network", "gradient_boosting"])
def test_fits_of_many_passes_get_the_dealt_rows(spark, monkeypatch, kind):
    asked, spread = [], models._spread
    monkeypatch.setattr(models, "_spread", lambda df, columns: asked.append(list(columns)) or spread(df, columns))
    table = spark.range(0, 60, 1, 2).select(F.col("id").cast("double").alias("a"), (F.col("id") % 2).cast("int").alias("y"))
    models.fit(table, kind, ["a"], "y", maxIter=1)
    assert asked == [["a", "y"]]


def test_missing_shares(spark):
    table = spark.createDataFrame([(1.0, None), (None, None), (float("nan"), 2.0)], "a double, b double")
    assert filters.missing_shares(table, ["a", "b"]) == {"a": 1 / 3, "b": 2 / 3}
    assert filters.missing_shares(table.limit(0), ["a"]) == {"a": 0.0}
    assert filters.missing_shares(table, []) == {}


def test_the_fill_is_worked_out_once_for_its_medians(spark, monkeypatch):
    rows = [("A", i, float(i) if i % 3 else None) for i in range(30)]
    table = spark.createDataFrame(rows, "station string, event_id long, x_lag_1 double").withColumn("ts", F.timestamp_seconds("event_id"))
    ran, fill = spark.sparkContext.accumulator(0), ordering.fill_series

    def counted(df, columns):
        seen = F.udf(lambda x: ran.add(1) or x, "double").asNondeterministic()
        return fill(df, columns).withColumn("x_lag_1", seen("x_lag_1"))

    monkeypatch.setattr(ordering, "fill_series", counted)
    state = stages._fit_fill(table, {"columns": ["x_lag_1"], "skip": []})
    assert state["medians"] == {"x_lag_1": 14.0} and ran.value == 30


def test_a_forest_deals_rows_of_few_parts(spark, monkeypatch):
    one = spark.range(0, 1000, 1, 1).select(F.col("id").cast("double").alias("a"), (F.col("id") % 2).alias("y"))
    before, edges, *_ = forest.Forest(columns=["a"], labelCol="y")._rows(one)
    monkeypatch.setattr(forest, "DEALT_ROWS", 100)
    rows, cuts, n, _ = forest.Forest(columns=["a"], labelCol="y")._rows(one)
    sizes = session.part_sizes(rows)
    assert n == sum(sizes) == 1000 and len(sizes) > 1 and not session.uneven(sizes, spark.sparkContext.defaultParallelism)
    assert [len(c) for c in cuts] == [len(c) for c in edges]
    assert sorted((r.row, r.y) for r in rows.collect()) == sorted((r.row, r.y) for r in before.collect())  # a row keeps its number


def test_forest_selection_reads_dealt_rows(spark, monkeypatch, tmp_path):
    kind, value = "if(id % 9 = 0, 'error', 'view') AS event_type", "CAST(id * 7 % 997 AS DOUBLE) / 10 AS value"
    when, props = "CAST(timestamp_seconds(id * 60) AS TIMESTAMP_NTZ) AS ts", "concat('{\"k\": ', id % 100, '}') AS props"
    events = spark.range(0, 1000, 1, 1).selectExpr("id AS event_id", when, "id % 5 AS user_id", kind, value, props)
    events.write.parquet(str(tmp_path / "events.parquet"))
    run, seen, chosen = all_queries()["forest_selection"].run, [], models.important_features
    monkeypatch.setitem(models.SETTINGS, "random_forest", {**models.SETTINGS["random_forest"], "numTrees": 4, "maxDepth": 4})
    monkeypatch.setattr(models, "important_features", lambda df, *args: seen.append(session.part_sizes(df)) or chosen(df, *args))
    before = rows_of(run(spark, str(tmp_path)))
    monkeypatch.setattr(session, "DEALT_ROWS", 100)
    assert rows_of(run(spark, str(tmp_path))) == before
    cores = spark.sparkContext.defaultParallelism
    assert [(sum(x), session.uneven(x, cores)) for x in seen] == [(1000, True), (1000, False)]
