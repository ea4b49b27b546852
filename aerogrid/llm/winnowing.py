"""Benchmark decontamination by winnowing.

Texts become lower-case words.  Of every `w` neighbouring `k`-gram hashes the least is a fingerprint;
with k + w - 1 equal to the window length, two texts that share a whole window share a fingerprint
inside it.  The fingerprints of the documents are joined to those of the benchmark, and each hit is
extended: the word windows around it are compared with the windows of the items, word by word.
An item shorter than the window is one window of its own length, so each window length that occurs
(at most `window` of them) has its own k and w; the documents are cut into words and hashed once for all lengths.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerogrid.llm.common import ascii_lower, broadcast_if_small, let, packed, row_key
from aerogrid.session import settle

#: Fixed by the contract: runs of these characters are words, after A-Z became lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in a text whose A-Z are still in upper case, where only their number is asked.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
GRAM = 5
SEP = " "
BITS = 6  # of a packed fingerprint that hold its position; a window has fewer than 2 ** BITS grams


def words(text: Column) -> Column:
    """Lower-case words; none for null."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def _least(values: Column, width: int) -> Column:
    """The least of each `width` neighbours; by doubling, so that a place is compared log(width) times."""

    def step(at_hand: Column, size: int) -> Column:
        if size == width:
            return at_hand
        by = min(size, width - size)
        pairs = lambda m: F.zip_with(m, F.slice(m, by + 1, F.size(m)), lambda x, y: F.least(x, y))  # noqa: E731  # nulls at the end are skipped
        return let(at_hand, lambda m: step(pairs(m), size + by))

    return let(values, lambda g: F.slice(step(g, 1), 1, F.size(g) - (width - 1)))


def _fingerprints(tokens: Column, lengths: list[int], gram: int) -> Column:
    """Array of (len, h, p): gram hash and position of each fingerprint, for windows of each of the lengths in words."""
    mask = (1 << BITS) - 1

    def grams(h: Column, k: int) -> Column:
        hashed = lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)])
        tagged = lambda i: F.shiftleft(hashed(i), BITS).bitwiseOR(i.bitwiseAND(F.lit(mask)))
        return F.when(F.size(h) >= k, F.transform(F.sequence(F.lit(0).cast("long"), (F.size(h) - k).cast("long")), tagged))

    def distinct(m: Column, length: int) -> Column:
        entry = lambda v, i: F.struct(
            F.lit(length).alias("len"),
            F.shiftright(v, BITS).alias("h"),
            (i + F.pmod(v.bitwiseAND(F.lit(mask)) - i, F.lit(mask + 1))).cast("int").alias("p"),
            ((i == 0) | (v != F.get(m, i - 1))).alias("new"),
        )
        return F.filter(F.transform(m, entry), lambda x: x["new"])

    def of_length(h: Column, g: Column, length: int) -> Column:
        w = length - min(gram, length) + 1
        return F.when(F.size(h) >= length, let(_least(g, w) if w > 1 else g, lambda m: distinct(m, length)))

    def all_lengths(h: Column) -> Column:
        parts = []
        for k in sorted({min(gram, length) for length in lengths}):
            own = [length for length in lengths if min(gram, length) == k]
            found = lambda g, own=own: F.flatten(F.array_compact(F.array(*[of_length(h, g, length) for length in own])))
            parts.append(let(grams(h, k), found))
        return F.flatten(F.array_compact(F.array(*parts)))

    return let(F.transform(tokens, lambda x: F.xxhash64(x)), all_lengths)


def _window_rows(tokens: Column, starts: Column, length: Column) -> Column:
    """Array of (start, window) for the given start positions."""
    return let(tokens, lambda t: F.transform(starts, lambda s: F.struct(s.alias("s"), F.array_join(F.slice(t, s + 1, length), SEP).alias("win"))))


def item_windows(items: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """Rows (len, win, h list, item): each item's windows of `window` words, or its one shorter window."""
    tok = items.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w"))
    return tok.where(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(window)))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    share: int = 20,
) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in an occurrence of an item's window; a document is contaminated if
    at least one word in `share` is hit.  Null or wordless texts have no words, hits or items; null item ids are
    not listed, but their windows count as hits; repeated rows all get the same result; empty tables
    give no rows or no hits; other columns are ignored.
    """
    doc_id, text = F.col(id_col), F.col(text_col)
    keyed = docs.select(doc_id.alias("_id"), text.alias("_text"), *row_key(doc_id, text))
    found = _occurrences(keyed, items, item_col, item_text_col, window, gram)
    per_doc = _summary(found)
    tail = broadcast_if_small(settle(per_doc))
    n_words = F.coalesce(F.regexp_count(F.col("_text"), F.lit(RAW_WORD)), F.lit(0)).cast("long")
    counted = keyed.select("_id", "_k1", "_k2", n_words.alias("n_words")).join(tail, ["_k1", "_k2"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return counted.select(
        F.col("_id").alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that are not contaminated, with their columns as they were.

    Documents without a hit pass by a join with the few keys that are contaminated.  Null, empty and wordless texts have no
    hits and stay, also if their id is null; rows that repeat id and text go or stay together; an empty table stays empty; no
    column name clashes.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    window, gram, share = options.get("window", WINDOW), options.get("gram", GRAM), options.get("share", 20)
    keys = row_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    keyed = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), *keys)
    found = _occurrences(keyed, items, options.get("item_col", "item_id"), options.get("item_text_col", "text"), window, gram)
    bad = _summary(found).where((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n"))).select("_k1", "_k2")
    return packed(docs, *keys).join(broadcast_if_small(settle(bad)), ["_k1", "_k2"], "left_anti").select("_row.*")


def _occurrences(keyed: DataFrame, items: DataFrame, item_col: str, item_text_col: str, window: int, gram: int) -> DataFrame:
    """Rows (key, n, s, e, items): windows of items found in documents, at words s up to e."""
    tok = settle(item_windows(items, item_col, item_text_col, window))
    lengths = sorted(r[0] for r in tok.select("len").distinct().collect())  # at most `window` numbers
    if not lengths:
        nothing = keyed.select("_k1", "_k2", F.lit(0).alias("n"), F.lit(0).alias("s"), F.lit(0).alias("e"))
        return nothing.withColumn("items", F.array().cast("array<string>")).where(F.lit(False))
    tokens, length = words(F.col("_text")), F.col("len")
    own = [tok.where(length == n).select(F.explode(_fingerprints(F.col("w"), [n], gram)).alias("f")).select("f.len", "f.h") for n in lengths]
    prints = reduce(DataFrame.unionByName, own).distinct()
    starts = F.sequence(F.lit(0), F.size("w") - length)
    wins = tok.select("item", "len", F.explode(_window_rows(F.col("w"), starts, length)).alias("x"))
    wins = wins.groupBy("len", F.col("x.win").alias("win")).agg(F.collect_set("item").alias("items"))

    in_docs = keyed.select("_k1", "_k2", F.explode(_fingerprints(tokens, lengths, gram)).alias("f"))
    in_docs = in_docs.select("_k1", "_k2", "f.len", "f.h", "f.p")
    hits = in_docs.join(broadcast_if_small(settle(prints)), ["len", "h"], "left_semi").groupBy("_k1", "_k2", "len").agg(F.collect_set("p").alias("ps"))
    hits = settle(hits.groupBy("_k1", "_k2").agg(F.collect_list(F.struct("len", "ps")).alias("of")))
    hit_docs = keyed.join(broadcast_if_small(hits), ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"]).select("_k1", "_k2", tokens.alias("w"), F.explode("of").alias("f"))
    hit_docs = hit_docs.select("_k1", "_k2", "w", F.size("w").alias("n"), "f.len", "f.ps")
    span = length - F.least(F.lit(gram), length)  # a window that holds the gram at p starts at p - span or later
    first, last = lambda p: F.greatest(p - span, F.lit(0)), lambda p: F.least(p, F.col("n") - length)
    none = F.array().cast("array<int>")
    around = F.array_distinct(F.flatten(F.transform("ps", lambda p: F.when(first(p) <= last(p), F.sequence(first(p), last(p))).otherwise(none))))
    cand = hit_docs.select("_k1", "_k2", "n", "len", F.explode(_window_rows(F.col("w"), around, length)).alias("x"))
    cand = cand.select("_k1", "_k2", "n", "len", F.col("x.s").alias("s"), (F.col("x.s") + length).alias("e"), F.col("x.win").alias("win"))
    return cand.join(broadcast_if_small(settle(wins)), ["len", "win"]).drop("win", "len")


def _summary(found: DataFrame) -> DataFrame:
    """Per document key: words, hit words (the union of the windows) and the items."""
    by_doc = Window.partitionBy("_k1", "_k2").orderBy("s", "e")
    before = F.max("e").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), F.coalesce(before, F.lit(0))))
    listed = F.array_sort(F.array_distinct(F.flatten(F.collect_set("items"))))
    return (
        found.withColumn("_new", new)
        .groupBy("_k1", "_k2")
        .agg(F.max("n").alias("n"), F.sum("_new").alias("n_hit"), listed.alias("_items"))
        .select(
            "_k1",
            "_k2",
            "n",
            "n_hit",
            F.size("_items").alias("n_items"),
            F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
        )
    )
