import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerogrid.llm import ngram_join
from aerogrid.llm.graph import components
from aerogrid.llm.ngram_join import candidate_edges, common_shingles, drop_near_duplicates, near_duplicate_classes, runs_for, shingles

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def expected(rows):
    """(id, class, set id, links) by brute force."""
    names = [shingle_set(t) or (t or "") for _, t in rows]
    sets = {}
    for (doc_id, _), name in zip(rows, names):
        old = sets.get(name)
        sets[name] = doc_id if old is None else old if doc_id is None else min(old, doc_id)
    keys = list(sets)
    linked = {k: [o for o in keys if o != k and isinstance(k, frozenset) and isinstance(o, frozenset) and len(k & o) >= 0.8 * len(k | o)] for k in keys}
    low = {}
    for k in keys:
        seen, todo = {k}, [k]
        while todo:
            for o in linked[todo.pop()]:
                if o not in seen:
                    seen.add(o)
                    todo.append(o)
        known = [sets[s] for s in seen if sets[s] is not None]
        low[k] = min(known) if known else None
    return sorted(((i, low[n], sets[n], len(linked[n])) for (i, _), n in zip(rows, names)), key=repr)


def texts_with_copies(rng, n=60, copies=5):
    word = lambda: "".join(rng.choice("abcdé") for _ in range(3))
    out, passage = [], [word() for _ in range(60)]
    for _ in range(n):
        base = [word() for _ in range(rng.randint(0, 120))]
        if rng.random() < 0.4:
            base = base[:40] + passage
        out.append(" ".join(base))
        for _ in range(rng.randint(0, copies)):
            near = list(base)
            for _ in range(rng.randint(0, 4)):
                if near:
                    near[rng.randrange(len(near))] = word()
            out.append(", ".join(near).upper() if rng.random() < 0.3 else " ".join(near))
    return out


OPTIONS = {"default": {}, "deep": {"small": 2, "depth": 4}, "blocks": {"small": 4, "block_sets": 3, "block_shingles": 200}}


@pytest.mark.parametrize("options", OPTIONS.values(), ids=list(OPTIONS))
def test_classes_and_links_equal_brute_force(spark, options):
    rows = list(enumerate(texts_with_copies(random.Random(7))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in near_duplicate_classes(docs, **options).collect()), key=repr)
    assert got == expected(rows)


def test_a_large_group_of_near_copies(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[: i % 200] + [f"x{i}"] + base[i % 200 + 1 :])) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_duplicate_classes(docs, block_sets=100).collect()
    assert {r.class_id for r in found} == {0}
    assert sorted((tuple(r) for r in found), key=repr) == expected(rows)
    assert drop_near_duplicates(docs).count() == 1


def test_edges_of_a_near_copy_group_follow_its_size(spark):
    """Twice the near copies give about twice the edges, in one block or in many, and still hold the group together."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 31, ngram_join.COORDINATES)
    made = {}
    for m in (600, 1200):
        rows = []
        for i in range(m):
            sign = base.copy()
            some = rng.choice(ngram_join.COORDINATES, 6, replace=False)
            sign[some] = rng.integers(0, 1 << 31, 6)
            rows.append((i.to_bytes(16, "big"), [int(x) for x in sign]))
        sets = spark.createDataFrame(rows, "set binary, sign array<int>")
        for block_sets in (4096, 32):
            edges = candidate_edges(sets, 0.8, ngram_join.RECALL, block_sets=block_sets)
            made[m, block_sets] = edges.count()
            assert components(edges).select("comp").distinct().count() == 1
    print(made)
    assert all(n <= 4 * m for (m, block_sets), n in made.items() if block_sets == 4096)
    assert all(n <= 12 * m + 64 * 64 for (m, block_sets), n in made.items() if block_sets == 32)


def test_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted((tuple(r) for r in near_duplicate_classes(odd).collect()), key=repr)
    assert got == expected(rows)
    left = drop_near_duplicates(odd)
    assert left.columns == odd.columns
    classes = {e[1] if e[1] is not None else e for e in expected(rows)}
    assert left.count() == len(classes)
    assert near_duplicate_classes(empty).collect() == [] and drop_near_duplicates(empty).collect() == []


def test_shingles_are_sets_of_runs():
    assert len(shingles("a b c d e f")) == 2 and len(shingles("a b")) == 1 and len(shingles(None)) == len(shingles("?!")) == 0
    assert (shingles("A b, c d e") == shingles("a b c d e")).all() and len(shingles("a " * 1000)) == 1
    sets = [shingles(t) for t in ("a b c d e f g", "a b c d e f h", "x y z", "a b c d e f g")]
    common = common_shingles(sets)
    assert [common[i, j] for i in range(4) for j in range(i)] == [2, 0, 0, 3, 2, 0]


def test_runs_follow_from_the_recall():
    assert runs_for(0.99999, 0.8, 3) > runs_for(0.99, 0.8, 3) > runs_for(0.99, 0.8, 1) >= 2


def test_word_cache_is_bounded(monkeypatch):
    cache = ngram_join._WordHashes({i: i for i in range(500_001)})
    assert cache[b"w"] == cache[b"w"] and len(cache) == 1


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200)]
    got = {r.v: r.comp for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_recall_over_the_tables(spark, sf_dir):
    """Every pair at or above the similarity shares a class; the rest are left alone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = sorted((tuple(r) for r in near_duplicate_classes(docs.withColumn("x", F.lit(1))).collect()), key=repr)
    assert got == expected(rows)


def test_the_loss_counts_the_signature_that_all_runs_share():
    for similarity in (0.8, 0.82, 0.85, 0.5, 1.0):
        runs = ngram_join.runs_for(ngram_join.RECALL, similarity, ngram_join.DEPTH)
        lost = ngram_join.loss_after(runs, ngram_join.RECALL, similarity, ngram_join.DEPTH)
        assert lost <= 1 - ngram_join.RECALL
    with pytest.raises(ValueError):
        runs_for(0.99999, 0.1, 3)


def test_signatures_of_pairs_at_exactly_the_similarity_pass_the_floor():
    """Pairs of nine shingles, eight of them common: about one of a million may fall below the floor."""
    rng = np.random.default_rng(5)
    need = ngram_join.least_alike(ngram_join.RECALL, 0.8)
    alike = []
    for _ in range(60_000):
        found = rng.integers(0, 1 << 64, 10, np.uint64)
        alike.append(int((ngram_join.signature(found[:9]) == ngram_join.signature(found[1:])).sum()))
    assert sum(a < need for a in alike) <= 1
