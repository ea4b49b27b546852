import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from aerogrid.llm.winnowing import contamination, drop_contaminated

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def expected(docs, items, window=13):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, item in items:
            iw = words(item)
            n = min(len(iw), window)
            wins = {tuple(iw[s : s + n]) for s in range(len(iw) - n + 1)} if n else set()
            for s in range(len(w) - n + 1 if n else 0):
                if tuple(w[s : s + n]) in wins:
                    hit |= set(range(s, s + n))
                    if item_id is not None:
                        found.add(str(item_id))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def check(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((tuple(r) for r in contamination(d, i).collect()), key=repr) == expected(docs, items)


def test_random_texts_with_planted_spans(spark):
    rng = random.Random(4)
    vocabulary = ["a", "b", "É", "c9", "Dd"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 4, 5, 6, 9, 12, 13, 14, 30]))) for i in range(8)] + [(99, ""), (98, None), (None, text(13)), (3, text(20))]
    docs = [(i, text(rng.randint(0, 60))) for i in range(30)]
    docs += [(100 + i, text(20) + ", " + (t or "").upper() + " " + text(20)) for i, (_, t) in enumerate(items)]
    docs += [(1, None), (2, ""), (None, items[4][1]), (200, docs[0][1]), (200, docs[0][1]), (300, "a " * 3000), (301, "zz " * 400 + items[9 - 2][1])]
    check(spark, docs, items)


def test_repeated_words_and_a_shared_passage(spark):
    items = [(1, "w " * 40), (2, " ".join(f"p{i}" for i in range(13))), (3, " ".join(f"p{i}" for i in range(1, 40)))]
    docs = [(i, f"x{i} " + " ".join(f"p{j}" for j in range(40)) + " end" * 300) for i in range(40)] + [(90, "w " * 12), (91, "w " * 13), (92, "w " * 500)]
    check(spark, docs, items)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=40), min_size=1, max_size=5), st.lists(st.lists(st.sampled_from("ab"), max_size=20), min_size=1, max_size=3))
def test_any_texts(spark, docs, items):
    check(spark, [(i, " ".join(d)) for i, d in enumerate(docs)], [(i, " ".join(d)) for i, d in enumerate(items)])


def test_odd_rows_and_empty_tables(spark, odd, empty):
    items = spark.createDataFrame([(1, "one two three"), (2, None)], "item_id long, text string")
    got = contamination(odd, items)
    assert got.count() == odd.count() and got.where("contaminated").count() == 4
    assert contamination(empty, items).collect() == []
    assert contamination(odd, items.where("false")).where("n_hit > 0").collect() == []
    left = drop_contaminated(odd, items)
    assert left.columns == odd.columns and left.count() == odd.count() - 4


@pytest.fixture(autouse=True)
def _keep(spark):
    yield
