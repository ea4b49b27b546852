import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from aerogrid.llm.exact_dedup import content_hash, drop_exact_duplicates, exact_duplicates
from tests.llm.conftest import ODD


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        first = True
        for i in ids:
            out.append((i, keep, len(ids), i == keep and first, sha))
            first = first and i != keep
    return sorted(out, key=repr)


@pytest.mark.parametrize("hashing", [content_hash, lambda t: F.length(t) % 3, lambda t: F.lit(1)], ids=["md5", "weak", "constant"])
def test_groups_are_equal_texts_even_if_hashes_collide(odd, hashing):
    got = [tuple(r) for r in exact_duplicates(odd, hashing=hashing).collect()]
    assert sorted(got, key=repr) == expected(ODD)


@pytest.mark.parametrize("hashing", [content_hash, lambda t: F.lit(1)], ids=["md5", "constant"])
def test_one_row_per_text_stays(odd, hashing):
    left = drop_exact_duplicates(odd, hashing=hashing)
    assert left.columns == odd.columns
    got = sorted(((r.doc_id, r.text or "") for r in left.collect()), key=repr)
    assert got == sorted(((keep, text) for keep, text in {(e[1], t) for e in expected(ODD) for _, t, *_ in ODD if hashlib.sha256((t or "").encode()).hexdigest() == e[4] for t in [t or ""]}), key=repr)


def test_empty_table(empty):
    assert exact_duplicates(empty).collect() == []
    assert drop_exact_duplicates(empty).collect() == []


def test_a_hot_group_leaves_tasks_as_one_row(spark):
    docs = spark.range(0, 30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    got = exact_duplicates(docs)
    assert got.where("kept").count() == 20_001
    assert got.where("group_size = 10000").select("keep_id").distinct().collect()[0][0] == 29_997
