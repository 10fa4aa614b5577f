"""Toxicity by FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features of a text are the set of its hashed words, neighbouring pairs and pairs
with one word between. Training follows each coordinate's own learning rate, and
the L1 term keeps only coordinates with evidence, so the weights are a short
list that is broadcast for scoring; its size is bounded by the hash space.

Learning uses at most about ``MAX_TRAINING_ROWS`` labelled rows, chosen by a
digest of the id; scoring reads every whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from asofspark.llm.common import checkpointed, column_of, in_parts, text_of, unused

if TYPE_CHECKING:
    import numpy as np

HASH_BITS = 20
MAX_TRAINING_ROWS = 24_000
PASSES = 12
"""Passes over the training rows, whatever their number."""
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 1.0
THRESHOLD = 0.3
CACHE_ENTRIES = 120_000

_PAIR, _SKIP, _MIX = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD
_EDGE = ".,;:!?\"'()[]{}<>|*#$%&-_…«»“”„"


class WordHashes(dict):
    """Word to 64 hashed bits, after case and outer punctuation are dropped; zero for a word of punctuation."""

    def __missing__(self, word: str) -> int:
        import xxhash

        plain = word.lower().strip(_EDGE)
        value = xxhash.xxh64_intdigest(plain) if plain else 0
        if len(word) <= 48:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = value
        return value


def features(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Hashed coordinates of a text, repeats included."""
    import numpy as np

    words = (text or "").split()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    h = h[h != 0]
    with np.errstate(over="ignore"):
        pairs = h[:-1] * np.uint64(_PAIR) + h[1:]
        skips = h[:-2] * np.uint64(_SKIP) + h[2:] * np.uint64(_PAIR)
        every = np.concatenate([h, pairs, skips]) * np.uint64(_MIX)
    return (every >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def fit_ftrl(rows: list[tuple[np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the weights that are not zero; the last coordinate is the intercept."""
    import numpy as np

    size = (1 << HASH_BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    bias = size - 1

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - np.where(at == bias, 0.0, L1), 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(PASSES):
        for found, label in rows:
            at = np.append(found, bias)
            w = weights(at)
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum())))) - label
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    w = weights(np.arange(size))
    keep = np.flatnonzero(w)
    return keep, w[keep]


def held_out(doc_id: Column) -> Column:
    """Whether labels of this id are never learned from; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAINING_ROWS) -> DataFrame:
    """(turn, label, text) of about ``limit`` labelled documents at most, none held out.

    Rows with a null id, label or text are left out; an id with several labels
    counts as toxic if one says so, and an id with several texts takes the least.
    """
    known = labels.select(column_of(labels, "doc_id").alias("doc_id"), column_of(labels, "toxic").cast("double").alias("label")).dropna()
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    turn = F.md5(F.col("doc_id").cast("string"))
    share = limit / max(limit, known.count())
    picked = known.withColumn("turn", turn).filter(F.conv(F.substring("turn", 1, 12), 16, 10).cast("double") < share * 16.0**12)
    texts = docs.select(column_of(docs, "doc_id").alias("doc_id"), column_of(docs, "text").alias("text")).dropna()
    return texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "turn", "label").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAINING_ROWS) -> tuple[list[int], list[float]]:
    """Sparse weights; without a labelled row the intercept alone, at zero.

    Features are taken where the rows lie. The bounded set of training rows then
    goes through one task in the order of their digests.
    """

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        hashes = WordHashes()
        for b in in_parts(batches):
            found = [np.unique(features(t, hashes)).astype(np.int32) for t in b["text"]]
            yield pd.DataFrame({"turn": b["turn"], "label": b["label"], "found": found})

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(t, f, y) for b in batches for t, f, y in zip(b["turn"], b["found"], b["label"], strict=True)]
        rows.sort(key=lambda r: r[0])
        if rows:
            at, w = fit_ftrl([(f.astype("int64"), y) for _, f, y in rows])
            yield pd.DataFrame({"at": at, "weight": w})

    rows = training_rows(docs, labels, limit).mapInPandas(extract, "turn string, label double, found array<int>")
    learned = checkpointed(rows).coalesce(1).mapInPandas(fit, "at long, weight double").collect()
    return [r.at for r in learned], [r.weight for r in learned]


def scorer(spark: SparkSession, weights: tuple[list[int], list[float]]):
    """Text column to score column, with the weights broadcast."""
    import numpy as np

    table = np.zeros((1 << HASH_BITS) + 1, np.float32)
    if weights[0]:
        table[np.array(weights[0])] = weights[1]
    sent = spark.sparkContext.broadcast(table)

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes, w = WordHashes(), sent.value

        def one(text: str | None) -> float:
            found = features(text, hashes)
            found = np.unique(found[w[found] != 0])
            return 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w[found].sum(dtype=np.float64) + w[-1])))))

        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype="float64")

    return score


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted per document.

    Null and empty texts get the score of the intercept. Only texts enter the
    score: no id, label, language or source. Equal rows all appear; other columns
    are not read.
    """
    score = scorer(docs.sparkSession, train(docs, labels))
    rows = docs.select(column_of(docs, "doc_id").alias("doc_id"), held_out(column_of(docs, "doc_id")).alias("held_out"), score(text_of(docs)).alias("score"))
    return rows.select("*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents below the threshold, with the columns of ``docs``, whatever their names.

    Null and empty texts are scored by the intercept; repeated rows all stay or go.
    """
    (name,) = unused(docs, "toxicity")
    score = scorer(docs.sparkSession, train(docs, labels))
    return docs.withColumn(name, score(text_of(docs))).filter(F.col(name) < THRESHOLD).drop(name)
