"""Exact duplicates by a 128-bit content hash, with the bytes of each group compared.

Hashes are grouped first, without texts.  Only the texts whose hash occurs more than once are read
again; the least and the greatest text of a group are equal exactly if all its texts are, and both are
taken map-side, so a group of any size leaves each task as one row.  Groups whose texts differ (a
collision) are told apart by the text itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerogrid.llm.common import broadcast_if_small, packed, tie_order
from aerogrid.session import settle


def content_hash(text: Column) -> Column:
    """128 bits of content hash."""
    return F.unhex(F.md5(text.cast("binary")))


def _collided(hashed: DataFrame, counts: DataFrame) -> DataFrame | None:
    """Hashes shared by different texts; None if there are none."""
    repeated = broadcast_if_small(counts.where("_n > 1").select("_h"))
    spans = hashed.join(repeated, "_h", "left_semi").groupBy("_h").agg(F.min("_text").alias("_lo"), F.max("_text").alias("_hi"))
    bad = settle(spans.where(F.col("_lo") != F.col("_hi")).select("_h"))
    return None if bad.isEmpty() else bad


def _with_variant(hashed: DataFrame, bad: DataFrame | None) -> DataFrame:
    """Add `_variant`: the text where the hash is shared by different texts, else null."""
    if bad is None:
        return hashed.withColumn("_variant", F.lit(None).cast("string"))
    marked = broadcast_if_small(bad).withColumn("_bad", F.lit(True))
    return hashed.join(marked, "_h", "left").withColumn("_variant", F.when(F.col("_bad"), F.col("_text"))).drop("_bad")


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    hashing: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays.  A null text counts as empty; a null id is
    smaller than any other; of repeated rows with the same id and text exactly one is kept.  An empty
    table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    hashed = rows.withColumn("_h", hashing(F.col("_text")))
    digest = F.sha2(F.col("_text").cast("binary"), 256).alias("_sha")
    light = settle(hashed.groupBy("_h", "_id", digest).agg(F.count(F.lit(1)).alias("_c")))
    bad = _collided(hashed, light.groupBy("_h").agg(F.sum("_c").alias("_n")))
    if bad is None:
        per_row = light.withColumn("_variant", F.lit(None).cast("string"))
    else:
        per_row = _with_variant(hashed, bad).groupBy("_h", "_variant", "_id", digest).agg(F.count(F.lit(1)).alias("_c"))
    groups = per_row.groupBy("_h", F.col("_variant").alias("_v")).agg(
        F.max("_id").alias("_keep"), F.sum("_c").alias("_n")
    )
    joined = per_row.join(groups.withColumnRenamed("_h", "_gh"), (F.col("_h") == F.col("_gh")) & F.col("_variant").eqNullSafe(F.col("_v")))
    # repeated rows are one row with a count until here
    copies = joined.select("*", F.explode(F.sequence(F.lit(1), F.col("_c"))).alias("_i"))
    return copies.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        (F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_i") == 1)).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    hashing: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """The rows of `docs` that stay, with all columns as they were: one per text, the largest id.

    Rows that tie in text and id are told apart by their other columns, so reruns agree.
    """
    marked = packed(docs, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    hashed = marked.withColumn("_h", hashing(F.col("_text")))
    counts = settle(hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")))
    order = F.struct(F.col(f"_row.`{id_col}`"), tie_order(docs, text_col))
    best = F.max_by("_row", order).alias("_row")
    return _with_variant(hashed, _collided(hashed, counts)).groupBy("_h", "_variant").agg(best).select("_row.*")
