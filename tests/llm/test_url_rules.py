import re
import time
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from aerogrid.llm.url_rules import RULES, judge_urls, label_pages, label_pages_by_language, mine_rules, tokens_of
from aerogrid.session import settle

URLS = [
    "http://a.example.net/en/1", "https://EXAMPLE.net/en/", "http://example.net/english", "http://net/", "http://net", "http://x.NET/de/3?q=/en/", "http://example.com/de/", "http://m.example.com/de/4#x",
    "http://notexample.com/de/4", "http://example.com/DE/4", "ftp://y.org/fr/1", "http://org/fr", "http://y.org?/fr/", "example.net/en/", "", None, "://", "http://", "x://y://net/", "http://a.net:80/", "http://é.net/\n/en",
]


def split_url(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), path


def listed(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, "allow")


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], "url string, bad boolean")


def test_listed_rules(spark, nothing):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(None, URLS[0])] * 2, "page_id long, url string").selectExpr("*", "'h' AS host", "1 AS _id", "2 AS have")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, nothing).collect()}
    assert got == {(i, *split_url(u), *listed(*split_url(u))) for i, u in [*enumerate(URLS), (None, URLS[0])]}
    assert judge_urls(pages, nothing).count() == len(URLS) + 2
    assert judge_urls(pages.where("false"), nothing).collect() == []


@pytest.fixture
def labelled(spark):
    n = F.col("id")
    url = F.concat(
        F.lit("http://"), F.when(n % 3 == 0, "casino").otherwise("news"), F.lit(".site"), (n % 7).cast("string"), F.lit(".com/"), F.when(n % 2 == 0, "win").otherwise("read"), F.lit("/"), n.cast("string")
    )
    return spark.range(2100).select(url.alias("url"), ((n % 6 == 0) | (n % 97 == 0)).alias("bad"))


def test_mined_rules_hold_their_support_and_confidence_and_are_minimal(labelled):
    known = labelled.select(tokens_of(F.col("url")).alias("tokens"), "bad")
    rules = mine_rules(settle(known), min_support=0.01, min_confidence=0.8)[0].collect()
    rows = known.collect()
    assert {frozenset(r.tokens) for r in rules} >= {frozenset({"host:casino", "path:win"})}
    for r in rules:
        held = [x.bad for x in rows if set(r.tokens) <= set(x.tokens)]
        assert abs(sum(held) / len(held) - r.confidence) < 1e-9 and r.confidence >= 0.8 and sum(held) >= 25
        assert not any(set(o.tokens) < set(r.tokens) for o in rules)


def plain_rules(rows, least, min_confidence):
    """All minimal sets of tokens that imply the bad label, by brute force over the subsets of the bad URLs' tokens."""
    bad = [t for t, b in rows if b]
    found = []
    for size in range(1, 1 + max(map(len, bad))):
        sets = {c for t in set(bad) for c in map(frozenset, combinations(sorted(t), size))}
        for c in sets:
            if any(r <= c for r in found) or sum(c <= t for t in bad) < least:
                continue
            held = [b for t, b in rows if c <= t]
            if sum(held) / len(held) >= min_confidence:
                found.append(c)
    return found


def judged_plainly(rows, tokens, least, min_confidence):
    rules = plain_rules(rows, least, min_confidence)
    return {k: any(r <= t for r in rules) for k, t in tokens.items()}


@pytest.mark.parametrize(("least", "confidence"), [(25, 0.8), (40, 0.35), (10, 0.55)])
def test_verdicts_equal_those_of_all_minimal_rules(spark, labelled, least, confidence):
    rows = [(frozenset(r.t), r.bad) for r in labelled.select(tokens_of(F.col("url")).alias("t"), "bad").collect()]
    extra = [(1, "http://casino.new.org/win/a"), (2, "http://casino.x.net/win/"), (3, None), (4, "http://news.site1.com/read/"), (5, "ftp://casino")]
    pages = labelled.select(F.xxhash64("url").alias("page_id"), "url").unionByName(spark.createDataFrame(extra, "page_id long, url string"))
    tokens = {r.page_id: frozenset(r.t) for r in pages.select("page_id", tokens_of(F.col("url")).alias("t")).collect()}
    want = judged_plainly(rows, tokens, least, confidence)
    got = judge_urls(pages, labelled, min_support=0.0, min_confidence=confidence, least=least).collect()
    assert len(got) == pages.count()
    for r in got:
        assert r.verdict == ("block" if r.rule == "net/" or want[r.page_id] and r.rule is None else "allow")
    assert {r.verdict for r in got} == {"allow", "block"}


def test_tokens_that_always_come_together_are_one_item(spark):
    """Thirty fixed words in each URL of a site, 80 % of them bad: any of the words is the rule, and it takes no 2^30 sets."""
    words = "/".join(f"word{i}" for i in range(30))
    n = F.col("id")
    labelled = spark.range(400).select(F.when(n % 2 == 0, F.concat(F.lit(f"http://bad.com/{words}/"), n.cast("string"))).otherwise(F.concat(F.lit("http://good.com/a/"), n.cast("string"))).alias("url"), ((n % 2 == 0) & (n % 10 != 0)).alias("bad"))
    known = labelled.select(tokens_of(F.col("url")).alias("tokens"), "bad")
    began = time.monotonic()
    rules, items = mine_rules(settle(known))
    assert [r.tokens for r in rules.collect()] == [["host:bad"]]
    assert {r.token for r in items.where("item = 'host:bad'").collect()} == {"host:bad", *(f"path:word{i}" for i in range(30))}
    pages = spark.createDataFrame([(1, "http://other.com/word7"), (2, "http://other.com/word"), (3, "http://bad.com")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in judge_urls(pages, labelled).collect()} == {1: "block", 2: "allow", 3: "block"}
    assert time.monotonic() - began < 60


def test_a_rule_needs_all_its_items(spark):
    """Two tokens that are bad only together, beside words that come in nested groups."""
    rows = []
    for i in range(600):
        a, b = i % 2 == 0, i % 3 == 0
        path = "/".join(w for w, has in (("aa", a), ("bb", b), *((f"deep{j}", i % 600 < 60 * j) for j in range(1, 9))) if has)
        rows.append((f"http://h.com/{path}/x", a and b))
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    known = [(frozenset(r.t), r.bad) for r in labelled.select(tokens_of(F.col("url")).alias("t"), "bad").collect()]
    got = mine_rules(settle(labelled.select(tokens_of(F.col("url")).alias("tokens"), "bad")), min_confidence=0.9)[0].collect()
    assert {frozenset(r.tokens) for r in got} == set(plain_rules(known, 25, 0.9)) == {frozenset({"path:aa", "path:bb"})}


def test_labels_come_by_document_number(spark):
    pages = spark.createDataFrame([("http://a.com/en/7.html",), ("http://a.com/en/8?x=7",), ("http://a.com/99999999999999999999",), (None,), ("http://a.com/x7",)], "url string")
    labels = spark.createDataFrame([(7, 0, 0), (7, 1, 0), (8, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert {tuple(r) for r in label_pages(pages, labels).collect()} == {("http://a.com/en/7.html", True), ("http://a.com/en/8?x=7", False)}


def test_tokens(spark):
    row = spark.createDataFrame([("HTTPS://M.Example.com/en/12.html?page=2#top",), (None,)], "u string").select(tokens_of(F.col("u"))).collect()
    assert row[0][0] == ["scheme:https", "host:m", "host:example", "host:com", "path:en", "path:0", "path:html", "more:page", "more:0", "more:top"]
    assert row[1][0] == []


def test_languages_are_mined_from_the_urls_that_show_them(spark, sf_dir):
    pages, docs = spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    labelled = label_pages_by_language(pages, docs, "de")
    langs = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = labelled.collect()
    assert rows and all(r.bad == (langs[int(re.search(r"/([0-9]+)(?:[./]|$)", split_url(r.url)[1])[1])] == "de") for r in rows)
