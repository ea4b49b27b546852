"""URL filtering by a rule list and by association rules mined from labelled URLs.

A URL becomes a set of tokens, and tokens that always come together become one item.  FP-growth finds combinations
of items that are frequent among labelled URLs; those that imply the bad label with enough confidence and support are
the mined rules, less those that contain a shorter one.  Rules are matched by an inverted index: a rule stands under its rarest
item, so only URLs with that item are compared with the rest of the rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerogrid.llm.common import ascii_lower, broadcast_if_small
from aerogrid.session import settle

#: Fixed by the contract: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BAD = "label:bad"
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.6
LEAST_URLS = 25  # labelled URLs that a combination must occur in at least


def _rest(url: Column) -> Column:
    """What follows the first `://`; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """Up to `/`, `?`, `#` or the end, A-Z in lower case; empty without `://`."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens: labels of the host, words of path and query; numbers count as one token each place."""

    def part(prefix: str, text: Column) -> Column:
        words = F.filter(F.split(ascii_lower(text), r"[^\p{L}\p{N}-]+"), lambda w: w != "")
        return F.transform(words, lambda w: F.concat(F.lit(prefix), F.regexp_replace(w, r"^[0-9]+$", "0")))

    rest = F.coalesce(_rest(url), F.lit(""))
    scheme = F.when(_rest(url).isNotNull(), F.array(F.concat(F.lit("scheme:"), ascii_lower(F.substring_index(url, "://", 1))))).otherwise(F.array().cast("array<string>"))
    query = F.regexp_extract(rest, r"^[^?#]*([?#][\s\S]*)", 1)
    return F.array_distinct(F.concat(scheme, part("host:", host_of(url)), part("path:", path_of(url)), part("more:", query)))


def listed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does."""
    found = []
    for verdict, rule_host, rule_path in rules:
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        found.append(F.when(fits, F.struct(F.lit(len(rule_host + rule_path)).alias("n"), F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*found)) if len(found) else F.lit(None)


def _items(labelled: DataFrame) -> DataFrame:
    """Rows (token, item, n, bad): tokens that occur in the same labelled URLs are one item, named after the least of them.

    `n` and `bad` count the URLs, and the bad ones.  Rules that differ only in such tokens say the same of every labelled URL.
    """
    numbered = labelled.withColumn("_row", F.monotonically_increasing_id())
    spread = numbered.select("_row", "bad", F.explode("tokens").alias("token"))
    where = [F.bit_xor(F.xxhash64(F.lit(i), "_row")).alias(f"_x{i}") for i in (1, 2)]
    per_token = spread.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad"), *where)
    alike = per_token.groupBy("n", "bad", "_x1", "_x2").agg(F.min("token").alias("item"))
    return per_token.join(alike, ["n", "bad", "_x1", "_x2"]).select("token", "item", "n", "bad")


def _as_items(rows: DataFrame, key: str, tokens: str, items: DataFrame) -> DataFrame:
    """Rows (key, have): the distinct items of the tokens; without any there is no row."""
    spread = rows.select(key, F.explode(tokens).alias("token")).join(broadcast_if_small(items), "token")
    return spread.groupBy(key).agg(F.collect_set("item").alias("have"))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, least: int = LEAST_URLS) -> tuple[DataFrame, DataFrame]:
    """Rules (tokens, confidence, support) and tokens (token, item), from settled rows (tokens, bad).

    A rule's tokens are items; a URL has an item if it has any of its tokens.  Support is the share of labelled URLs that have the
    items and are bad; at least `least` URLs must.  Rules that hold all items of another rule are left out: items that are a rule
    alone are not mined further, nor are those that too few bad URLs or all URLs have.  Without labels there are no rules.
    """
    spark = labelled.sparkSession
    n = labelled.count()
    if n < least:
        return spark.createDataFrame([], "tokens array<string>, confidence double, support double"), spark.createDataFrame([], "token string, item string")
    support = min(1.0, max(min_support, least / n))
    items = settle(_items(labelled).where(F.col("bad") >= F.lit(support * n - 1e-9)))
    confidence = (F.col("bad") / F.col("n")).alias("confidence")
    alone = items.where("token = item").select(F.array("item").alias("tokens"), confidence, (F.col("bad") / n).alias("support")).where(F.col("confidence") >= min_confidence)
    rest = items.where((F.col("bad") / F.col("n") < min_confidence) & (F.col("n") < n))
    rows = settle(labelled.withColumn("_row", F.monotonically_increasing_id()))
    found = _as_items(rows, "_row", "tokens", rest.select("token", "item")).join(rows.select("_row", "bad"), "_row")
    baskets = found.select(F.when(F.col("bad"), F.concat("have", F.array(F.lit(BAD)))).otherwise(F.col("have")).alias("items"))
    some = found.count()
    mined = alone
    if some:  # the others have no item, so the support is taken of fewer
        rules = FPGrowth(itemsCol="items", minSupport=min(1.0, max(0.0, support * n - 1e-6) / some), minConfidence=min_confidence).fit(baskets).associationRules
        bad = rules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD))
        several = settle(bad.select(F.sort_array("antecedent").alias("tokens"), "confidence", (F.col("support") * some / n).alias("support")))
        mined = alone.unionByName(several.join(broadcast_if_small(settle(_wider(several))), "tokens", "left_anti"))
    return settle(mined), settle(items.select("token", "item"))


def _wider(rules: DataFrame) -> DataFrame:
    """Rows (tokens): the rules, of two items at least, that hold all items of a shorter one.

    A rule stands under its two rarest items, so only rules that have both are compared with it.
    """
    often = rules.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    rare = rules.select("tokens", F.explode("tokens").alias("t")).join(broadcast_if_small(often), "t")
    two = rare.groupBy("tokens").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "t"))), 1, 2).alias("two"))
    index = two.select(F.sort_array("two.t").alias("two"), F.col("tokens").alias("shorter"))
    pairs = F.flatten(F.transform("tokens", lambda x, i: F.transform(F.slice("tokens", i + 2, F.size("tokens")), lambda y: F.array(x, y))))
    asked = rules.where(F.size("tokens") > 2).select("tokens", F.explode(pairs).alias("two"))
    inside = (F.size("shorter") < F.size("tokens")) & (F.size(F.array_except("shorter", "tokens")) == 0)
    return asked.join(index, "two").where(inside).select("tokens").distinct()


def _matches(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows (key, have) that have all items of a rule, by an inverted index: a rule stands under the item that fewest rows have."""
    every = rules.select("tokens", F.explode("tokens").alias("t"))
    asked = broadcast_if_small(settle(every.select("t").distinct()))
    postings = settle(rows.select("key", F.explode("have").alias("t")).join(asked, "t"))
    often = postings.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    rarest = every.join(often, "t").groupBy("tokens").agg(F.min(F.struct("n", "t")).alias("rarest"), F.count(F.lit(1)).alias("_seen"))
    index = rarest.where(F.col("_seen") == F.size("tokens")).select("tokens", F.col("rarest.t").alias("t"))  # else no row has some item
    first = postings.join(broadcast_if_small(settle(index)), "t").select("key", "tokens")
    alone = first.where(F.size("tokens") == 1).select("key")
    longer = first.where(F.size("tokens") > 1).join(rows, "key").where(F.size(F.array_except("tokens", "have")) == 0)
    return alone.unionByName(longer.select("key")).distinct()


def judge_urls(pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, **mining) -> DataFrame:
    """One row per page: id, host, path, rule, verdict.

    `labelled` has rows (url, bad) to mine from.  The verdict is that of the longest listed rule that
    fits, else block if a mined rule matches, else allow.  Null URLs and URLs without `://` have an
    empty host and path and no rule, and are allowed; repeated rows get equal results; empty tables
    give no rows or no mined rules; other columns are ignored.
    """
    known = labelled.select(tokens_of(F.col("url")).alias("tokens"), "bad").where("bad IS NOT NULL")
    mined, items = mine_rules(settle(known), **mining)
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    rows = rows.select("*", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    rows = rows.withColumn("_listed", listed_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("_listed.verdict", F.when(F.col("_caught"), "block").otherwise("allow"))
    if mined.isEmpty():
        judged = rows.withColumn("_caught", F.lit(False))
    else:
        open_urls = rows.where("_listed IS NULL AND _url IS NOT NULL").select("_url").distinct()
        have = _as_items(open_urls.select(F.col("_url").alias("key"), tokens_of(F.col("_url")).alias("tokens")), "key", "tokens", items)
        caught = settle(_matches(settle(have), mined)).select(F.col("key").alias("_url"), F.lit(True).alias("_caught"))
        judged = rows.join(broadcast_if_small(caught), "_url", "left")
    return judged.select(F.col("_id").alias(id_col), "host", "path", F.col("_listed.rule").alias("rule"), verdict.alias("verdict"))


def label_pages(pages: DataFrame, labels: DataFrame, url_col: str = "url") -> DataFrame:
    """Rows (url, bad): pages whose path names a labelled document by number; low quality or toxic is bad."""
    number = F.expr("try_cast(_n AS BIGINT)")
    numbered = pages.select(F.col(url_col).alias("url"), F.regexp_extract(path_of(F.col(url_col)), r"/([0-9]+)(?:[./]|$)", 1).alias("_n"))
    bad = labels.select(F.col("doc_id").alias("_doc"), ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    known = bad.where("_doc IS NOT NULL").groupBy("_doc").agg(F.max("bad").alias("bad"))
    return numbered.withColumn("_doc", number).where("_doc IS NOT NULL").join(known, "_doc").select("url", "bad")


def label_pages_by_language(pages: DataFrame, docs: DataFrame, lang: str, url_col: str = "url") -> DataFrame:
    """Rows (url, bad): pages whose path names a document by number; those of the given language count as bad, null ones as others."""
    number = F.expr("try_cast(_n AS BIGINT)")
    numbered = pages.select(F.col(url_col).alias("url"), F.regexp_extract(path_of(F.col(url_col)), r"/([0-9]+)(?:[./]|$)", 1).alias("_n"))
    known = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_doc")).agg(F.max(F.coalesce(F.col("lang") == lang, F.lit(False))).alias("bad"))
    return numbered.withColumn("_doc", number).where("_doc IS NOT NULL").join(known, "_doc").select("url", "bad")
