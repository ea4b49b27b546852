"""Quality classifier by Bradley-Terry pairwise ranking.

Every document has a feature vector of its text.  Pairs of a good and a bad labelled document are
preferences; a logistic loss on the feature differences gives the weights, so that a document's strength
is one weighted sum.  The strength at a quantile of the labelled scores is the threshold.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from aerogrid.llm.common import packed
from aerogrid.llm.language_id import held_out
from aerogrid.session import settle

#: Labelled documents are paired in groups of about this many, by a hash; half of it of the rarer class go to every group.
GROUP_DOCS = 24_000
BINS = 1_000  # that one pass of a rank search counts
PAIRS_PER_DOC = 4
PENALTY = 1e-4
#: Fixed by the contract: scores from here on are predicted good.
CUT = 0.7
FEATURES = (
    "log_words", "word_length", "distinct_words", "repeated_next", "top_word", "distinct_lines", "line_words",
    "upper", "digits", "stops", "exclaims", "symbols", "symbol_words", "upper_words", "sentence_ends", "spaces",
    "empty",
)
EMPTY = [0.0] * (len(FEATURES) - 1) + [1.0]
_ASCII = np.arange(256)
_UPPER = (_ASCII >= 65) & (_ASCII <= 90)
_LETTER = _UPPER | ((_ASCII >= 97) & (_ASCII <= 122)) | (_ASCII >= 128)
_DIGIT = (_ASCII >= 48) & (_ASCII <= 57)
_SPACE = np.isin(_ASCII, [9, 10, 11, 12, 13, 32])
_STOP = np.isin(_ASCII, [ord(c) for c in ".,;:?'\"()-"])
_EXCLAIM = _ASCII == ord("!")
_SYMBOL = ~(_LETTER | _DIGIT | _SPACE | _STOP | _EXCLAIM)


def features_of(text: str | None) -> list[float]:
    """Shares and means over the whole text; without words only `empty` is set."""
    words = (text or "").split()
    if not words:
        return EMPTY
    n = len(words)
    lines = [line for line in text.split("\n") if line.strip()]
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    total, letters = counts.sum(), max(1, counts[_LETTER].sum())
    vocabulary = Counter(words)
    return [
        float(np.log1p(n)),
        float(np.log(sum(map(len, words)) / n)),
        len(vocabulary) / n**0.8,
        sum(map(eq, words, words[1:])) / n,
        vocabulary.most_common(1)[0][1] / n,
        len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        float(counts[_UPPER].sum() / letters),
        *(float(counts[c].sum() / total) for c in (_DIGIT, _STOP, _EXCLAIM, _SYMBOL)),
        sum(not w[-1].isalnum() and w[-1] not in ".,;:?!'\"()-" for w in words) / n,
        sum(map(str.isupper, words)) / n,
        sum(w[-1] in ".!?" for w in words) / n,
        float(counts[_SPACE].sum() / total),
        0.0,
    ]


@F.pandas_udf(ArrayType(DoubleType()))
def features(texts: pd.Series) -> pd.Series:
    return pd.Series([features_of(t) for t in texts], dtype=object)


@dataclass(frozen=True)
class RankingModel:
    weights: list[float]
    threshold: float

    def strength(self, vector: Column) -> Column:
        return F.aggregate(F.zip_with(vector, F.array(*[F.lit(w) for w in self.weights]), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)

    def score(self, vector: Column) -> Column:
        """Chance-like score in 0..1 that reaches CUT exactly where the strength reaches the threshold."""
        shift = float(np.log(CUT / (1 - CUT)))
        return 1 / (1 + F.exp(-(self.strength(vector) - self.threshold) - shift))


def _paired(rows: pd.DataFrame, per_doc: int) -> pd.DataFrame:
    """Feature differences of one group, good minus bad or the reverse with label 0; both classes take turns to be paired."""
    ordered = rows.sort_values(["_hash", "_id", "_h1"])
    good, bad = (ordered[ordered["_label"] == label] for label in (1, 0))
    xg, xb = (np.array(part["_x"].tolist()).reshape(-1, len(FEATURES)) for part in (good, bad))
    most = max(len(xg), len(xb)) if len(xg) and len(xb) else 0
    turn = np.arange(most * per_doc)
    label, diff = [turn % 2], [xg[turn % max(1, len(xg))] - xb[(turn + turn // max(1, most)) % max(1, len(xb))]] if most else [xg[:0]]
    own = np.flatnonzero(good["_own"].to_numpy())
    label.append(own % 2)
    diff.append(xg[own] - np.array(EMPTY))
    label, diff = np.concatenate(label), np.concatenate(diff)
    return pd.DataFrame({"label": label.astype(float), "x": list(diff * np.where(label == 1, 1.0, -1.0)[:, None])})


def _pairs(taught: DataFrame, sizes: dict[int, int], per_doc: int) -> DataFrame:
    """Preference pairs of all labelled documents: each meets `per_doc` or more of the other class in its group.

    Each good document is preferred to a text without words as well, which labels seldom have.  A class too rare for all
    groups to have some of it goes to every group.
    """
    groups = -(-sum(sizes.values()) // GROUP_DOCS)
    own = F.pmod("_h2", F.lit(groups)).cast("int")
    rare = [label for label, n in sizes.items() if n <= GROUP_DOCS // 2]
    everywhere = F.when(F.col("_label").isin(rare), F.sequence(F.lit(0), F.lit(groups - 1))).otherwise(F.array(own))
    spread = taught.withColumn("_group", F.explode(everywhere)).withColumn("_own", F.col("_group") == own)

    def paired(rows: pd.DataFrame) -> pd.DataFrame:
        return _paired(rows, per_doc)

    pairs = spread.select("_group", "_label", "_hash", "_id", "_h1", "_x", "_own").groupBy("_group").applyInPandas(paired, "label double, x array<double>")
    return pairs.select("label", array_to_vector("x").alias("features"))


def _at_rank(values: DataFrame, rank: int) -> float:
    """The value of column `_s` at a rank from 0 on; each pass brings the counts of at most BINS + 1 ranges to the driver."""
    low, high = values.agg(F.min("_s"), F.max("_s")).first()
    while low < high:
        inside = values.where(F.col("_s").between(low, high))
        place = F.floor((F.col("_s") - low) / F.lit(high - low) * BINS).cast("int")
        for r in inside.groupBy(place.alias("_p")).agg(F.count(F.lit(1)).alias("n"), F.min("_s").alias("low"), F.max("_s").alias("high")).orderBy("_p").collect():
            if rank < r["n"]:
                break
            rank -= r["n"]
        low, high = r["low"], r["high"]
    return float(low)


def _rank_threshold(values: DataFrame, n: int, level: float) -> float:
    """`_threshold` of rows of weight 1, from the rows in `values` as they are distributed."""
    k = max(1, min(n, int(np.ceil((level - 1e-9) * n))))
    return (_at_rank(values, k - 1) + _at_rank(values, min(k, n - 1))) / 2


def _threshold(strengths: np.ndarray, good: np.ndarray, weight: np.ndarray, level: float | None) -> float:
    """Strength at the `level` quantile of the weighted sample; by default the level is the weighted share of label 0.

    The value lies halfway between two neighbouring strengths.
    """
    order = np.argsort(strengths, kind="stable")
    s, w, g = strengths[order], weight[order], good[order]
    level = w[~g].sum() / w.sum() if level is None else level
    k = int(np.searchsorted(np.cumsum(w) / w.sum(), level - 1e-9, side="left")) + 1
    below, above = s[max(0, min(k, len(s)) - 1)], s[min(k, len(s) - 1)]
    return float((below + above) / 2)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    quantile: float | None = None,
) -> RankingModel:
    """Weights from preference pairs of all labelled documents, and the threshold at a quantile of all their scores.

    The level of the quantile is by default the share of label 0.  Labels other than 0 and 1 and ids without a
    document teach nothing; rows that repeat an id and its text teach once; without documents of both classes every text has the
    same score, CUT.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_label IN (0, 1) AND _id IS NOT NULL").distinct()
    key = F.col(id_col)  # texts stay where they are, only their features move
    vectors = docs.select(key.alias("_id"), F.xxhash64(key, text_col).alias("_h1"), F.xxhash64(F.lit(11), text_col, key).alias("_h2"), features(text_col).alias("_x"))
    once = vectors.join(known, "_id").groupBy("_h1", "_h2", "_label").agg(F.first("_id").alias("_id"), F.first("_x").alias("_x"))
    taught = settle(once.select("_id", "_label", "_h1", "_h2", F.xxhash64(F.lit(5), "_id").alias("_hash"), "_x"))
    sizes = {r["_label"]: r["n"] for r in taught.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if len(sizes) < 2:
        return RankingModel([0.0] * len(FEATURES), 0.0)
    fitter = LogisticRegression(fitIntercept=False, regParam=PENALTY, maxIter=100, tol=1e-7)
    weights = [float(w) for w in fitter.fit(settle(_pairs(taught, sizes, PAIRS_PER_DOC))).coefficients.toArray()]
    strengths = settle(taught.select(RankingModel(weights, 0.0).strength(F.col("_x")).alias("_s")))
    n = sum(sizes.values())
    return RankingModel(weights, _rank_threshold(strengths, n, sizes[0] / n if quantile is None else quantile))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per document: id, held_out, score, predicted; learnt from labels that are not held out.

    Null and empty texts are scored like any other; repeated rows get equal scores; an empty table gives
    an empty result; only the text is an input of the score; other columns, whatever their names, are ignored.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    model = train(rows, labels.where(~held_out(id_col)).select(F.col(id_col).alias("_id"), label_col), "_id", "_text", label_col)
    scored = rows.select("_id", model.score(features("_text")).alias("score"))
    return scored.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of `docs` that are predicted good, with their columns as they were.

    Null, empty and very long texts and null ids are scored like any other; rows that repeat a text go or stay together; an
    empty table stays empty; no column name clashes.  Without labels of both classes all rows stay.
    """
    model = train(docs, labels.where(~held_out(id_col)), id_col, text_col, label_col)
    marked = packed(docs, model.score(features(F.col(f"`{text_col}`"))).alias("_score"))
    return marked.where(F.col("_score") >= CUT).select("_row.*")
