"""Held-out accuracy of the learnt operators, and their behaviour without anything to learn."""

import math
import zlib
from collections import Counter

import numpy as np

from aerogrid.llm import language_id, quality
from aerogrid.llm.queries import QUERIES


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_quality_on_held_out_labels(spark, sf_dir):
    rows = {r.doc_id: r for r in QUERIES["op1_quality_ranking"](spark, sf_dir).collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert len(rows) == docs.count()
    assert all(r.held_out == is_held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows.values())
    held = [(rows[x.doc_id].predicted, x.quality) for x in labels if is_held_out(x.doc_id)]
    assert np.mean([p == q for p, q in held]) > 0.9


def test_quality_does_not_see_ids_or_labels_of_held_out_rows(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality", "toxic")
    a = quality.score_quality(docs, labels).collect()
    b = quality.score_quality(docs.withColumn("lang", docs.source), flipped).collect()
    assert sorted((r.doc_id, round(r.score, 9)) for r in a) == sorted((r.doc_id, round(r.score, 9)) for r in b)


def test_quality_on_odd_rows(spark, odd, empty, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    scored = odd.select("text", model.score(quality.features("text")).alias("s")).collect()
    blank = [r.s for r in scored if not (r.text or "").strip()]
    assert len(set(blank)) == 1 and blank[0] < quality.CUT
    none = labels.where("false")
    assert {round(r.score, 6) for r in quality.score_quality(odd, none).collect()} == {0.7}
    assert quality.score_quality(empty, labels).collect() == []
    left = quality.drop_low_quality(odd, none)
    assert left.columns == odd.columns and left.count() == odd.count()


def test_threshold_is_a_quantile():
    s, good, w = np.array([0.0, 1, 2, 3]), np.array([False, False, True, True]), np.ones(4)
    assert quality._threshold(s, good, w, None) == 1.5
    assert quality._threshold(s, good, w, 0.25) == 0.5
    assert quality._threshold(s, np.array([False, True, False, True]), w, 0.75) == 2.5
    assert quality._threshold(s, good, np.array([1.0, 1, 1, 1]), None) == quality._threshold(s, good[::-1], w, None)  # the share decides


def test_rank_threshold_is_that_of_the_whole_table(spark):
    rng = np.random.default_rng(1)
    for s in (rng.normal(size=3_000), np.repeat([1.0, 2.0, 5.0], 700), np.array([3.0])):
        values = spark.createDataFrame([(float(x),) for x in s], "_s double").repartition(3)
        for level in (0.0, 0.3, 1 / 3, 1.0):
            assert quality._rank_threshold(values, len(s), level) == quality._threshold(s, s > 0, np.ones(len(s)), level)


def test_every_labelled_document_teaches_in_any_number_of_groups(spark, monkeypatch):
    rows = [(i, int(i % 10 > 0), i * 7, i * 13, i, [float(i)] * len(quality.FEATURES)) for i in range(400)]
    taught = spark.createDataFrame(rows, "_id long, _label int, _h1 long, _h2 long, _hash long, _x array<double>")
    for group in (1_000, 100, 60):
        monkeypatch.setattr(quality, "GROUP_DOCS", group)
        pairs = [(r.label, r.features[0]) for r in quality._pairs(taught, {0: 40, 1: 360}, 4).collect()]
        signed = [x if label else -x for label, x in pairs]  # the good document's value less that of the other
        assert len(pairs) >= 4 * 360 + 360
        good = {i for i in range(400) if i % 10}
        assert all(any(float(g) == x for x in signed) for g in good)  # against the empty text, whose value is 0
        assert sum(float(int(x)) != x for x in signed) == 0


def test_every_quality_score_comes_from_the_weights(spark, sf_dir, odd):
    """Each score again in plain numpy, from the learnt weights and the features of the whole text."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    rows = docs.select("text").unionByName(odd.select("text")).withColumn("s", model.score(quality.features("text"))).collect()
    for r in rows:
        strength = float(np.dot(quality.features_of(r.text), model.weights))
        assert abs(r.s - 1 / (1 + np.exp(-(strength - model.threshold)) * (1 - quality.CUT) / quality.CUT)) < 1e-9


def plain_buckets(text, bits):
    """Bucket of every 1- to 4-gram, character by character in plain integers."""
    letters = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    for n in range(1, 5):
        for at in range(len(letters) - n + 1):
            h = 0
            for i, c in enumerate(letters[at : at + n], 1):
                h = (h * 0x100000001B3 + ord(c) + i) % 2**64
            yield (h * 0x9E3779B97F4A7C15 % 2**64) >> (64 - bits)


def test_language_model_and_scores_equal_a_plain_bayes(spark, sf_dir):
    """Counts in dicts and logs added one by one, in learning and in scoring."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 1500")
    model = language_id.train(docs)
    rows = [r for r in docs.collect() if r.text is not None]
    counts = {lang: Counter() for lang in model.langs}
    for r in rows:
        if r.lang is not None:
            counts[r.lang].update(plain_buckets(r.text, model.bits))
    size, smooth = 1 << model.bits, language_id.SMOOTHING
    prior = Counter(r.lang for r in rows if r.lang is not None)
    got = {r.doc_id: r._lang for r in language_id.identify(docs.select("doc_id", "text"), model).collect()}
    for r in rows[::3]:
        if not any(c.isalpha() for c in r.text):
            continue
        logs = []
        for lang in model.langs:
            total = sum(counts[lang].values()) + smooth * size
            logs.append(math.log(prior[lang] / sum(prior.values())) + sum(math.log((counts[lang][b] + smooth) / total) for b in plain_buckets(r.text, model.bits)))
        best = int(np.argmax(logs))
        chance = 1 / sum(math.exp(x - logs[best]) for x in logs)
        assert got[r.doc_id].lang_pred == model.langs[best] and abs(got[r.doc_id].score - chance) < 1e-3


def test_language_on_held_out_rows(spark, sf_dir):
    rows = {r.doc_id: r for r in QUERIES["op7_language_id"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows.values())
    assert np.mean([rows[d.doc_id].lang_pred == d.lang for d in docs if is_held_out(d.doc_id)]) > 0.95


def test_language_on_odd_rows(odd, empty):
    rows = language_id.identify_held_out(odd).collect()
    assert len(rows) == odd.count()
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in rows:
        if r.doc_id is not None and not any(map(str.isalpha, texts[r.doc_id] or "")):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert {r.lang_pred for r in language_id.identify_held_out(odd.withColumn("lang", odd.lang.substr(9, 2)).replace("", None, ["lang"])).collect()} == {"und"}
    assert language_id.identify_held_out(empty).collect() == []


def test_blocks_of_a_long_text_have_the_same_ngrams(monkeypatch):
    text = "Ünïcode und 12 mehr, " * 50
    whole = [np.sort(np.concatenate(x)) for x in [list(language_id.buckets_of(text, 12))]]
    monkeypatch.setattr(language_id, "BLOCK", 37)
    parts = np.sort(np.concatenate(list(language_id.buckets_of(text, 12))))
    assert (whole[0] == parts).all()
