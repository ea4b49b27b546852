"""Each stage against brute force on what the stage before it kept."""

import re
from collections import defaultdict

import pytest

import corpus_pipeline
from tests.llm import test_ngram_join, test_winnowing


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        frame = docs.toPandas()
        out.append(frame)
        docs = spark.createDataFrame(frame) if name != corpus_pipeline.STAGES[-1][0] else docs
    return out


def test_all_but_the_last_keep_the_columns(stages):
    assert [list(s.columns) for s in stages[1:-1]] == [list(stages[0].columns)] * (len(stages) - 2)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_ranking", "exact_copies", "near_copies", "decontamination", "source_mix"]


def test_quality_agrees_with_the_labels(stages, spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    kept = set(stages[1].doc_id)
    assert (labels.doc_id.isin(kept) == (labels.quality == 1)).mean() > 0.9


def test_exact_copies(stages):
    before, after = stages[1], stages[2]
    assert sorted(after.doc_id) == sorted(before.groupby("text").doc_id.max())


def test_near_copies(stages):
    before, after = stages[2], stages[3]
    rows = list(before[["doc_id", "text"]].itertuples(index=False, name=None))
    assert sorted(after.doc_id) == sorted({e[1] for e in test_ngram_join.expected(rows)})


def test_decontamination(stages, spark, sf_dir):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before, after = stages[3], stages[4]
    want = test_winnowing.expected(list(before[["doc_id", "text"]].itertuples(index=False, name=None)), items)
    assert sorted(after.doc_id) == sorted(e[0] for e in want if not e[5])


def test_mix(stages):
    before, after = stages[4], stages[5]
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in before.itertuples()}
    assert dict(zip(after.doc_id, after["size"])) == size
    taken = defaultdict(int)
    for r in after.itertuples():
        taken[(r.source_size, r.target)] += r.taken
    assert sum(taken.values()) == pytest.approx(sum(size.values()), rel=0.02)


def test_run_writes_and_rereads_each_stage(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert sorted(got.itertuples(index=False, name=None)) == sorted(stages[-1].itertuples(index=False, name=None))


def test_stages_take_odd_and_empty_tables(spark, odd, sf_dir):
    docs = odd.selectExpr("*", "1 AS n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() >= 0
        assert stage(spark, docs.where("false"), sf_dir).count() == 0
