import re
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aerogrid.llm.mixing import WEIGHTS, fit_budget, mix


def expected_targets(sizes):
    weights = {s: WEIGHTS[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        open_ = {s for s in sizes if s not in full}
        share = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return {s: share.get(s, 3.0 * sizes[s]) for s in sizes}
        full |= over


def sums(counts):
    reached = {0}
    for n, c in counts.items():
        reached = {r + n * k for r in reached for k in range(c + 1)}
    return reached


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 6), min_size=1, max_size=6), st.integers(0, 800), st.sampled_from([0, 50, 1 << 16]))
def test_budget_is_met_as_well_as_the_lengths_allow(counts, budget, knapsack):
    taken = fit_budget(counts, budget, knapsack)
    words, total = sum(n * c for n, c in taken.items()), sum(n * c for n, c in counts.items())
    assert all(0 <= taken[n] <= counts[n] for n in taken)
    if budget >= total:
        assert words == total
    else:
        assert abs(budget - words) <= max(counts)
    small = {n: 1 for n in counts}  # an even share takes none of these, so all is left to the program
    words = sum(n * c for n, c in fit_budget(small, budget).items())
    assert abs(words - budget) == min(abs(s - budget) for s in sums(small))


def check(docs):
    rows = mix(docs).collect()
    given_rows = docs.select("doc_id", "source", "text").collect()
    sizes = defaultdict(int)
    for r in given_rows:
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want = expected_targets(sizes)
    assert sorted(((r.doc_id, r.size) for r in rows), key=repr) == sorted(((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in given_rows), key=repr)
    by_target = defaultdict(int)
    for r in rows:
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
        by_target[(r.source_size, round(r.target, 3))] += r.taken
    assert {(sizes[s], round(t, 3)) for s, t in want.items()} == set(by_target)
    return want, by_target


def test_targets_and_sizes_on_odd_rows(odd, empty):
    check(odd)
    assert mix(empty).collect() == []


def test_taken_words_meet_the_targets_and_reruns_agree(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want, got = check(docs)
    lengths = defaultdict(dict)
    for r in docs.collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        lengths[r.source][n] = lengths[r.source].get(n, 0) + 1
    for source, target in want.items():
        size = sum(n * c for n, c in lengths[source].items())
        rest = target - int(target / size) * size
        best = min(abs(s - rest) for s in sums({n: c for n, c in lengths[source].items() if n}))
        # the even share of each length comes first, so the best sum is not always reached
        assert abs(got[(size, round(target, 3))] - target) <= best + 10
    again = mix(docs.repartition(7, "text"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mix(docs).collect()))


def test_a_hot_length_is_taken_in_part(spark):
    docs = spark.range(0, 9_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") < 8_000, "a").otherwise("b").alias("source"))
    rows = mix(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()
    assert {(r.source_size, round(r.target), r.t) for r in rows} == {(24_000, 19286, 19287), (3_000, 7714, 7713)}


def test_repeated_rows_are_taken_one_by_one(spark):
    docs = spark.createDataFrame([(1, "a b", "a")] * 100 + [(2, "c d", "b")] * 100, "doc_id long, text string, source string")
    rows = mix(docs).groupBy("target").agg(F.sum("taken").alias("t"), F.count("*").alias("n")).collect()
    assert {(round(r.target), r.t, r.n) for r in rows} == {(286, 286, 100), (114, 114, 100)}
