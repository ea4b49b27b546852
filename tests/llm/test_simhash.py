"""SimHash groups against brute force over all pairs."""

import re

import numpy as np
import pytest
import xxhash

from aerogrid.llm.simhash import anchors, code_tables, fingerprint, links, simhash_groups


def plain_fingerprint(text):
    words = [w.decode("utf-8", "replace") for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()) for w in [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w)]]
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(r.encode(), 42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance=2):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    values = np.array(prints, np.uint64)
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= distance):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def expected(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    groups = plain_components(prints)
    least = {}
    for (doc_id, _), g in zip(rows, groups, strict=True):
        if doc_id is not None:
            least[g] = min(doc_id, least.get(g, doc_id))
    return sorted(((d, f"{p:016x}", least.get(g)) for (d, _), p, g in zip(rows, prints, groups, strict=True)), key=repr)


def test_code_is_perfect_and_reaches_every_code_word_near():
    flips, beyond, first, within = code_tables(2)
    assert (within[0] == 1).all()  # one code word within the radius of every word
    assert len(flips) == 44_552 and within[2].sum() == len(flips)
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 63, 300, np.uint64) * np.uint64(2)
    for flip in ([3], [1, 60], [0, 22], [22, 23], [45, 46], [7, 30]):
        y = x ^ np.uint64(sum(1 << b for b in flip))
        at_home = {(i, a) for i, a, h in zip(*anchors(x, 0), strict=True) if h}
        assert len(at_home) == len(x)
        assert at_home <= set(zip(*anchors(y, 2)[:2], strict=True))


def test_whole_table_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted((tuple(r) for r in simhash_groups(docs).collect()), key=repr)
    assert got == expected([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize(("homes", "visitors"), [(4096, 65536), (3, 5)])
def test_a_dense_cluster_in_blocks(spark, homes, visitors):
    """Most prints at one place: over-full anchors are dealt to blocks and no link is lost."""
    rng = np.random.default_rng(1)
    centre = int(rng.integers(0, 1 << 62))
    prints = {centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False)) for _ in range(400)} | set(rng.integers(0, 1 << 62, 100).tolist())
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    found = [(r.a, r.b) for r in links(spark.createDataFrame([(p,) for p in prints], "fp long"), homes=homes, visitors=visitors).collect()]
    known = {p: i for i, p in enumerate(prints)}
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in found:
        root[max(find(known[a]), find(known[b]))] = min(find(known[a]), find(known[b]))
    assert [find(i) for i in range(len(prints))] == plain_components([p % (1 << 64) for p in prints])


def test_odd_rows(spark, odd):
    got = sorted((tuple(r) for r in simhash_groups(odd).collect()), key=repr)
    assert got == expected([(r.doc_id, r.text) for r in odd.collect()])


def test_long_texts_of_every_kind():
    for text in ("x" * 100_000, "a b " * 50_000, "\n" * 100_000, "AÉ中 " * 30_000, "\x00 \x0b\x1c " * 20_000):
        assert fingerprint(text) == plain_fingerprint(text)


def test_empty_table(empty):
    assert simhash_groups(empty).collect() == []
