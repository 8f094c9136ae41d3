"""Toxicity by a character n-gram linear classifier with naive Bayes scaling.

A text's features are the character n-grams of its distinct words (lower case,
with word ends marked); a feature's value is the number of distinct words that
hold it.  Each feature is scaled by its naive Bayes log-count ratio between
toxic and other documents, and a logistic regression is fitted on the scaled
features.  The score is the logistic of the sum, from 0 to 1.

Labels are learned from a bounded, hash-ordered sample (``FIT_DOCS`` documents
of at most ``FIT_CHARS`` characters).  Every document is scored over its whole
text in one pass without a shuffle.

A null, empty or letterless text has no features and gets the score of the
intercept.  A label that is null is not learned from.  Without labelled rows
every score is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storecast.llm import bytewords as bw
from storecast.llm import charfeat as cf

FIT_DOCS = 4000
FIT_CHARS = 50_000
BITS = 19
ORDERS = (3, 4, 5)
SMOOTH = 0.2
EPOCHS = 120
RATE = 0.05
PENALTY = 1e-3
THRESHOLD = 0.7

SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])


def _doc_words(words: cf.LetterWords) -> tuple[np.ndarray, np.ndarray]:
    """(document, distinct word) pairs, each once."""
    n = max(1, len(words.size))
    pair = np.unique(words.doc.astype(np.int64) * n + words.distinct)
    return (pair // n).astype(np.int32), (pair % n).astype(np.int32)


class NbLinear:
    """Weights already scaled by the log-count ratios, and the intercept."""

    def __init__(self):
        self.weight = np.zeros(1 << BITS, np.float32)
        self.bias = -np.inf
        self.book = None            # word scores met before, per worker

    def fit(self, texts: list[str], labels: list[int], epochs: int = EPOCHS) -> "NbLinear":
        y = np.array(labels, np.float64)
        if not len(y):
            return self
        words = cf.merged(texts)
        doc, word = _doc_words(words)
        f, w = cf.features(words, BITS, ORDERS)
        n_words, n_docs = len(words.size), len(y)
        # Log-count ratios: distinct words with the feature, by class.
        size = 1 << BITS
        toxic = np.bincount(f, np.bincount(word, y[doc], n_words)[w], size) + SMOOTH
        other = np.bincount(f, np.bincount(word, 1 - y[doc], n_words)[w], size) + SMOOTH
        ratio = np.log(toxic / toxic.sum()) - np.log(other / other.sum())
        beta, bias = np.zeros(size), float(np.log((y.sum() + 0.5) / (n_docs - y.sum() + 0.5)))
        m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
        for step in range(1, epochs + 1):
            per_word = cf.summed((beta * ratio).astype(np.float32)[f], w, n_words)
            margin = bias + np.bincount(doc, per_word[word], n_docs)
            err = y - 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            grad = ratio * np.bincount(f, np.bincount(word, err[doc], n_words).astype(np.float32)[w], size) / n_docs - PENALTY * beta
            gb = err.mean()
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            c1, c2 = 1 - 0.9 ** step, 1 - 0.99 ** step
            beta += RATE * (m / c1) / (np.sqrt(v / c2) + 1e-8)
            bias += RATE * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
        self.weight, self.bias = (beta * ratio).astype(np.float32), bias
        return self

    def word_scores(self, words: cf.LetterWords) -> np.ndarray:
        f, w = cf.features(words, BITS, ORDERS)
        return cf.summed(self.weight[f].astype(np.float64), w, len(words.size))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.book is None:
            self.book = cf.ScoreBook(self.word_scores, 1)
        n = len(offsets) - 1
        if not np.isfinite(self.bias):      # never fitted
            return np.zeros(n)
        words = cf.LetterWords(data, offsets)
        per_word = self.book.of(words)[:, 0].astype(np.float64)
        doc, word = _doc_words(words)
        margin = self.bias + np.bincount(doc, per_word[word], n)
        return 1 / (1 + np.exp(-np.clip(margin, -700, 700)))


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, rows: int = FIT_DOCS,
          chars: int = FIT_CHARS) -> NbLinear:
    """A model of the labelled documents that ``may_learn`` (over doc_id) selects."""
    # The bound is on labelled rows, so ids are chosen among the labels first.
    marks = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
             .select("doc_id", F.col("toxic").cast("int").alias("_toxic")).where(may_learn)
             .groupBy("doc_id").agg(F.max("_toxic").alias("_toxic"))
             .orderBy(F.xxhash64("doc_id", F.lit(12)), "doc_id").limit(rows))
    joined = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")    # at most ``rows`` labels
    sample = fit_sample_rows(joined, rows, chars)
    return NbLinear().fit([t for t, _ in sample], [y for _, y in sample])


def fit_sample_rows(joined: DataFrame, rows: int, chars: int) -> list[tuple[str, int]]:
    """(text, label) of the already chosen rows, in a fixed order."""
    table = (joined.where(F.col("text").isNotNull() & (F.length("text") <= chars))
             .orderBy("doc_id", "text").limit(rows).toArrow())
    return list(zip(table.column("text").to_pylist(), table.column("_toxic").to_pylist()))


def _scorer(model: NbLinear):
    def run(batches):
        for batch in batches:
            data, offsets = bw.buffers(batch.column("text"))
            parts = [model.score(d, o) for _, _, d, o in bw.blocks(data, offsets)]
            if parts:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(parts))],
                                                 names=SCORED.names)
    return run


def score(docs: DataFrame, model: NbLinear) -> DataFrame:
    """doc_id and score of every row; reads ``doc_id`` and ``text`` only."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scorer(model), SCORED)
