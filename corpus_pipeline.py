"""The corpus pipeline: five stages of the training-data operators over `documents`.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the docs of the next one.  All stages but the last return the
columns of documents; the last returns the mix: one row per document that reached it, with the words taken.

All stages take nulls in any column, empty and very long texts, rows that repeat, empty tables and extra columns of any
name; what each makes of them is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aerogrid.llm import exact_dedup, mixing, ngram_join, quality, winnowing
from aerogrid.llm.common import table
from aerogrid.session import scratch_path


def quality_ranking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored like any other; rows that repeat a text go or stay together; without labels of both classes all stay.
    """
    return quality.drop_low_quality(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays.

    A null text is equal to an empty one, a null id is less than any other, and of rows that repeat id and text one stays.
    """
    return exact_dedup.drop_exact_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays.

    Texts without words are near nothing; a null id stays only in a group without others; of rows that repeat id and text one stays.
    """
    return ngram_join.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with too many words of benchmark passages go.

    Null, empty and wordless texts have none and stay; rows that repeat a text go or stay together; without items all stay.
    """
    return winnowing.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words to take of each document, so that the sources meet their weights.

    Null sources are one source, the last; null and empty texts have no words; rows that repeat are documents of their own, chosen by a hash.
    """
    return mixing.mix(docs)


STAGES = [
    ("quality_ranking", quality_ranking),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]

#: The classifier is learnt, so SQL cannot express the rows; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
