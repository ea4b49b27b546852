"""Secret scan with a trigram inverted index.

Each rule's expression gives a Boolean trigram query (trigrams.py).  The postings hold, for every
trigram that some rule asks for, the documents it occurs in; a document is a candidate of a rule if it
stands in the postings of all trigrams of a clause.  Only candidates are matched against the rule; rules
without a query are matched against every text.  Spans are found with SQL functions: the lengths of the
matches and of the pieces between them add up to the positions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerogrid.llm.common import broadcast_if_small, let, row_key
from aerogrid.llm.trigrams import trigram_query
from aerogrid.session import settle


@dataclass(frozen=True)
class Rule:
    """An expression valid in Java and Python; matches whose `group` is shorter than `least` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Fixed by the contract.  Runs are maximal, so their least length may stand in the expression.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Further kinds, by the published formats of the tokens.  No group repeats without end, which would take stack, and
#: what a match can start with many times in a row is bounded.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{20,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,1000}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z][A-Z ]* )?PRIVATE KEY-----"),
    Rule("url_login", r"[a-z]{2,10}://[A-Za-z0-9._-]{1,64}:[^\s/@:]{6,64}@[A-Za-z0-9.-]{3,}"),
)
RULES = BASE_RULES + MORE_RULES
CHUNK = 256


def _running(lengths: Column) -> Column:
    """Sums of all earlier elements, one more than there are elements; chunks keep it linear."""

    def grow(values: Column, first: Column) -> Column:
        start = F.array(first.cast("long"))
        return F.aggregate(values, start, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def sums(all_: Column) -> Column:
        chunks = F.floor((F.size(all_) - 1) / CHUNK).cast("int")
        part = lambda c: F.slice(all_, c * CHUNK + 1, CHUNK)
        total = lambda c: F.aggregate(part(c), F.lit(0).cast("long"), lambda a, x: a + x)
        offsets = grow(F.transform(F.sequence(F.lit(0), chunks), total), F.lit(0))
        inside = lambda off: F.transform(F.sequence(F.lit(0), chunks), lambda c: let(grow(part(c), F.get(off, c)), lambda g: F.slice(g, 1, F.size(g) - 1)))
        return let(offsets, lambda off: F.concat(F.flatten(inside(off)), F.array(F.element_at(off, -1))))

    return let(lengths, sums)


def rule_spans(text: Column, rule: Rule) -> Column:
    """Array of (kind, start, end) in code points, ends exclusive: leftmost matches that do not overlap."""
    pattern = F.lit(rule.pattern)

    def spans(found: Column) -> Column:
        pieces = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x).cast("long"))
        starts = _running(F.zip_with(F.slice(pieces, 1, F.size(found)), F.transform(found, lambda x: F.length(x).cast("long")), lambda a, b: a + b))

        def at(run: Column) -> Column:
            gap = lambda p, i: F.get(p, i)
            make = lambda p: F.transform(found, lambda m, i: F.struct(F.lit(rule.kind).alias("kind"), (F.get(run, i) + gap(p, i)).alias("start"), (F.get(run, i) + gap(p, i) + F.length(m)).alias("end")))
            return let(pieces, make)

        return let(starts, at)

    all_ = F.regexp_extract_all(text, pattern, F.lit(0))
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    placed = let(all_, lambda found: F.when(F.size(found) > 0, spans(found)).otherwise(empty))
    if rule.group == 0 and rule.least <= 1:
        return placed
    wanted = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    return let(wanted, lambda g: F.filter(placed, lambda s, i: F.length(F.get(g, i)) >= rule.least))


def _postings(keyed: DataFrame, grams: list[str]) -> DataFrame:
    """Rows (gram, key): the documents that hold each of the given trigrams."""
    low = keyed.select("_k1", "_k2", F.lower("_text").alias("_low"))
    asked = F.array(*map(F.lit, grams))
    held = F.filter(asked, lambda g: F.col("_low").contains(g))  # a lambda keeps the generated code small
    return low.select("_k1", "_k2", F.explode(held).alias("gram"))


def _candidates(keyed: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """Rows (key, kinds): per document the rules of which it has all trigrams of a clause."""
    asked = [(kind, i, len(c), g) for kind, clauses in queries.items() for i, c in enumerate(clauses) for g in sorted(c)]
    spark = keyed.sparkSession
    clause = F.broadcast(spark.createDataFrame(asked, "kind string, clause int, need int, gram string"))  # grows with the rules only
    postings = _postings(keyed, sorted({a[3] for a in asked}))
    counted = postings.join(clause, "gram").groupBy("_k1", "_k2", "kind", "clause", "need").agg(F.count(F.lit(1)).alias("have"))
    return counted.where("have >= need").groupBy("_k1", "_k2").agg(F.collect_set("kind").alias("_kinds"))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: id and `spans`, an array of (kind, start, end) by start, then rule order.

    Null and empty texts have no spans; repeated rows each get theirs; an empty table gives an empty
    result; other columns are ignored.
    """
    doc_id, text = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(doc_id.alias("_id"), text.alias("_text"), *row_key(doc_id, text))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    marked = keyed.withColumn("_kinds", F.lit(None).cast("array<string>"))
    if queries:
        marked = keyed.join(broadcast_if_small(settle(_candidates(keyed, queries))), ["_k1", "_k2"], "left")
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    parts = []
    for rule in rules:
        spans = rule_spans(F.col("_text"), rule)
        parts.append(F.when(F.array_contains("_kinds", rule.kind), spans).otherwise(empty) if rule.kind in queries else spans)
    order = {r.kind: i for i, r in enumerate(rules)}
    rank = F.create_map(*[F.lit(v) for kv in order.items() for v in kv])
    ranked = F.transform(F.flatten(F.array(*parts)), lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    spans = F.transform(F.array_sort(ranked), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return marked.select(F.col("_id").alias(id_col), spans.alias("spans"))


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: id, counts of the base kinds, digest of the base spans, all spans as text."""
    found = secret_spans(docs, id_col, text_col, rules)
    base = [r.kind for r in BASE_RULES]
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        id_col,
        *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(shown(F.filter("spans", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
    )
