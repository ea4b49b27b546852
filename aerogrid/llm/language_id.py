"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-gram buckets per language inside Spark tasks; the counts are summed by Spark and become
one matrix of log probabilities (buckets x languages), which is broadcast.  Scoring looks up the rows of
a text's buckets and adds them, in blocks of characters, so memory does not depend on the text length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerogrid.session import settle

UNKNOWN = "und"
SIZES = (1, 2, 3, 4)
#: At most about this many labelled documents per language are learnt from, chosen by a hash of their text.
TRAIN_DOCS = 40_000
#: The matrix has at most this many cells, so many languages get fewer buckets each.
MATRIX_CELLS = 1 << 23
MOST_BITS, LEAST_BITS = 16, 1  # very many languages have fewer buckets each, so the matrix keeps its bound
SMOOTHING = 0.2
BLOCK = 1 << 20
_NOT_LETTER = re.compile(r"[\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)


def held_out(id_col: str | Column) -> Column:
    """Documents that no model may learn from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def buckets_of(text: str, bits: int, sizes: tuple[int, ...] = SIZES) -> Iterator[np.ndarray]:
    """Bucket numbers of the n-grams of the letters of a text; runs of other characters count as one space."""
    letters = f" {_NOT_LETTER.sub(' ', text.lower()).strip()} "
    shift = np.uint64(64 - bits)
    reach = max(sizes) - 1
    for at in range(0, len(letters), BLOCK):
        code = np.frombuffer(letters[at : at + BLOCK + reach].encode("utf-32-le"), np.uint32).astype(np.uint64)
        h = np.zeros(len(code), np.uint64)
        for n in range(1, max(sizes) + 1):
            starts = min(BLOCK, len(code) - n + 1)
            if starts <= 0:
                break
            h = h[:starts] * _STEP + code[n - 1 : n - 1 + starts] + np.uint64(n)
            if n in sizes:
                yield ((h * _MIX) >> shift).astype(np.int64)


@dataclass(frozen=True)
class LanguageModel:
    langs: list[str]
    bits: int
    log_p: np.ndarray  # (buckets, languages)
    prior: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its posterior probability; (`und`, 0) for texts without letters or models without languages."""
        if not text or not self.langs or not any(map(str.isalpha, set(text))):
            return UNKNOWN, 0.0
        score = self.prior.copy()
        for found in buckets_of(text, self.bits):
            score += self.log_p[found].sum(axis=0, dtype=np.float64)
        best = int(score.argmax())
        return self.langs[best], float(1.0 / np.exp(score - score[best]).sum())


def _sample(labelled: DataFrame, limit: int) -> DataFrame:
    """About `limit` rows per language at most, by hash of the text."""
    counts = F.broadcast(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")))  # one row per language
    even = F.shiftrightunsigned(F.xxhash64("text"), 11) / F.lit(float(1 << 53))
    return labelled.join(counts, "lang").where(even * F.col("_n") < limit).select("text", "lang")


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", limit: int = TRAIN_DOCS) -> LanguageModel:
    """Learn from the rows with a language and a text; the bound on documents per language is `limit`."""
    labelled = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per language
    langs = sorted(r["lang"] for r in sizes)
    if not langs:
        return LanguageModel([], LEAST_BITS, np.zeros((1, 0), np.float32), np.zeros(0))
    bits = max(LEAST_BITS, min(MOST_BITS, (MATRIX_CELLS // len(langs)).bit_length() - 1))
    place = {lang: i for i, lang in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
                own = sums.setdefault(lang, np.zeros(1 << bits, np.int64))
                for found in buckets_of(text, bits):
                    own += np.bincount(found, minlength=1 << bits)
        for lang, own in sums.items():
            some = np.flatnonzero(own)
            columns = [pa.array(np.full(len(some), place[lang], np.int32)), pa.array(some.astype(np.int32)), pa.array(own[some])]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "n"])

    counted = _sample(labelled, limit).mapInArrow(count, "lang int, bucket int, n long")
    totals = settle(counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))).toPandas()  # at most MATRIX_CELLS rows
    table = np.zeros((1 << bits, len(langs)))
    table[totals["bucket"].to_numpy(), totals["lang"].to_numpy()] = totals["n"].to_numpy()
    log_p = np.log((table + SMOOTHING) / (table.sum(axis=0) + SMOOTHING * (1 << bits)))
    n_docs = np.array([next(r["n"] for r in sizes if r["lang"] == lang) for lang in langs], float)
    return LanguageModel(langs, bits, log_p.astype(np.float32), np.log(n_docs / n_docs.sum()))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", out: str = "_lang") -> DataFrame:
    """Add `out`, a struct of lang_pred and score; null texts and texts without letters are `und` with score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MATRIX_CELLS floats at most

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    return docs.withColumn(out, predicted(F.col(text_col)))


def identify_held_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score, by a model of the rows that are not held out.

    Null languages teach nothing; without any, all predictions are `und`; repeated rows get equal
    results; an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_known"))
    model = train(rows.where(~held_out("_id")), "_text", "_known")
    found = identify(rows.select("_id", "_text"), model, "_text")
    return found.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), "_lang.lang_pred", "_lang.score")
