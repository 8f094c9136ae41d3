"""Language identification with a linear-chain conditional random field.

Every word of letters gets a language.  Word scores are sums of learned weights
of affix, character n-gram and lexicon (whole word) features; learned
transitions favour staying in a language, which is how code-switched text is
cut.  Forward-backward gives each word's posterior; a document's language is
the one with the largest posterior mass, its score that mass over the number of
words.

The model is fitted by gradient ascent on the log-likelihood of a bounded,
hash-ordered sample of labelled documents (``FIT_DOCS`` documents of at most
``FIT_CHARS`` characters, up to ``RARE_DOCS`` of every label first, so that a rare
language is learned too); every word takes its document's label.  Scoring
covers whole texts of all documents, in one pass without a shuffle.  Chains are
cut into pieces whose transfer matrices are multiplied first, so a text of any
length costs few array steps; the result equals the plain recursion.

A null text or one without letters is ``und`` with score 0.  Ties go to the
smaller label.  Without any labelled row every text is ``und``.  A row with a
null id is scored and not held out.  Repeated rows are scored each; the fit reads
an id's rows once.  An empty table gives no rows.  Other columns may have any
name: only doc_id, text and the label are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from storecast.llm import bytewords as bw
from storecast.llm import charfeat as cf

FIT_DOCS = 600
FIT_CHARS = 50_000
RARE_DOCS = 20         # documents of a label that come before all others in the sample
BITS = 17
ORDERS = (1, 2, 3)
AFFIXES = (2, 3, 4)
PIECE = 64             # words of a chain handled in one sweep
EPOCHS = 20
RATE = 0.3
PENALTY = 1e-6
UNKNOWN = "und"
MIN_SCORE = 0.35       # documents below are rejected by ``accept``

PREDICTION = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()), T.StructField("n_words", T.LongType()),
    T.StructField("n_switches", T.LongType())])


def _features(words: cf.LetterWords):
    return cf.features(words, BITS, ORDERS, AFFIXES, lexicon=True)


class Pieces:
    """Word positions of some chains, cut into pieces of up to ``PIECE`` words.
    ``chain`` gives the (sorted) chain of every word."""

    def __init__(self, chain: np.ndarray):
        n = len(chain)
        new = np.ones(n, bool)
        new[1:] = chain[1:] != chain[:-1]
        start = np.flatnonzero(new)
        within = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
        first = within % PIECE == 0
        self.piece = np.cumsum(first) - 1
        self.slot = within % PIECE
        self.n = int(first.sum())
        head = np.flatnonzero(first)
        self.size = np.diff(np.append(head, n))
        self.order = within[head] // PIECE              # place of the piece in its chain
        self.mask = np.arange(PIECE)[None, :] < self.size[:, None]

    def fill(self, rows: np.ndarray) -> np.ndarray:
        out = np.ones((self.n, PIECE, rows.shape[1]), np.float32)
        out[self.piece, self.slot] = rows
        return out


def _scaled(x: np.ndarray, axes) -> np.ndarray:
    return x / np.maximum(x.sum(axis=axes, keepdims=True), 1e-30)


def forward_backward(scores: np.ndarray, trans: np.ndarray, p: Pieces):
    """Posterior of every word, (words, labels); with the messages a fit needs:
    before each word (``a_in``), the potentials, and after each word (``b``)."""
    labels = scores.shape[1]
    e = p.fill(np.exp(scores - scores.max(axis=1, keepdims=True)))
    t = np.exp(trans - trans.max()).astype(np.float32)
    a_in = np.full((p.n, labels), 1.0 / labels, np.float32)
    b_out = np.ones((p.n, labels), np.float32)
    last = int(p.order.max()) if p.n else 0
    if last:
        m = np.broadcast_to(np.eye(labels, dtype=np.float32), (p.n, labels, labels)).copy()
        for k in range(int(p.size.max())):
            step = _scaled((m @ t) * e[:, k, None, :], (1, 2))
            m = np.where(p.mask[:, k, None, None], step, m)
        by_order = np.argsort(p.order, kind="stable")
        cuts = np.searchsorted(p.order[by_order], np.arange(last + 2))
        for k in range(1, last + 1):
            i = by_order[cuts[k]:cuts[k + 1]]
            a_in[i] = _scaled(np.einsum("ni,nij->nj", a_in[i - 1], m[i - 1]), 1)
        for k in range(last, 0, -1):
            i = by_order[cuts[k]:cuts[k + 1]]
            b_out[i - 1] = _scaled(np.einsum("nij,nj->ni", m[i], b_out[i]), 1)
    width = int(p.size.max()) if p.n else 0
    before = np.empty((p.n, PIECE, labels), np.float32)
    alpha = np.empty((p.n, PIECE, labels), np.float32)
    a = a_in
    for k in range(width):
        before[:, k] = a
        step = _scaled((a @ t) * e[:, k], 1)
        a = np.where(p.mask[:, k, None], step, a)
        alpha[:, k] = a
    beta = np.empty((p.n, PIECE, labels), np.float32)
    b = b_out
    for k in range(width - 1, -1, -1):
        beta[:, k] = b
        step = _scaled((b * e[:, k]) @ t.T, 1)
        b = np.where(p.mask[:, k, None], step, b)
    at = (p.piece, p.slot)
    post = alpha[at] * beta[at]
    return post / post.sum(axis=1, keepdims=True), before[at], e[at], beta[at], t


class Crf:
    """Weights (features x labels), transitions and label names."""

    def __init__(self, labels: list[str]):
        self.labels = labels
        n = len(labels)
        self.weight = np.zeros((1 << BITS, n), np.float32)
        self.trans = np.zeros((n, n))
        self.book = None            # word scores met before, per worker

    def scores(self, words: cf.LetterWords) -> np.ndarray:
        f, w = _features(words)
        return cf.summed(self.weight[f], w, len(words.size))

    def fit(self, texts: list[str], langs: list[str], epochs: int = EPOCHS) -> "Crf":
        words = cf.merged(texts)
        if not len(words.doc) or len(self.labels) < 2:
            return self
        f, w = _features(words)
        gold = np.searchsorted(self.labels, langs)[words.doc]
        # A chain of the fit is one piece: long texts give several.
        whole = Pieces(words.doc)
        p = Pieces(whole.piece)
        n, n_labels = len(words.size), len(self.labels)
        one = np.zeros((len(gold), n_labels), np.float32)
        one[np.arange(len(gold)), gold] = 1
        head = np.zeros(len(gold), bool)
        head[np.searchsorted(p.piece, np.arange(p.n))] = True
        moves = np.zeros((n_labels, n_labels))
        np.add.at(moves, (gold[:-1][~head[1:]], gold[1:][~head[1:]]), 1)
        opened = np.bincount(gold[head], minlength=n_labels)
        total = len(gold)
        g2w, g2t = np.full_like(self.weight, 1e-8), np.full_like(self.trans, 1e-8)
        for _ in range(epochs):
            post, before, e, beta, t = forward_backward(self.scores(words)[words.distinct], self.trans, p)
            diff = one - post
            per_word = np.stack([np.bincount(words.distinct, diff[:, j], n) for j in range(n_labels)], 1)
            grad = np.stack([np.bincount(f, per_word[w, j], 1 << BITS) for j in range(n_labels)], 1)
            grad = (grad / total - PENALTY * self.weight).astype(np.float32)
            pair = before[:, :, None] * t[None] * (e * beta)[:, None, :]
            pair /= np.maximum(pair.sum(axis=(1, 2), keepdims=True), 1e-30)
            # The message into a chain is uniform, so its first move counts a share from every label.
            want = moves + opened[None, :] * pair[head].sum(axis=0) / np.maximum(pair[head].sum(axis=(0, 1)), 1e-12)
            move = (want - pair.sum(axis=0)) / total - 1e-3 * self.trans
            g2w += grad * grad
            g2t += move * move
            self.weight += RATE * grad / np.sqrt(g2w)
            self.trans += RATE * move / np.sqrt(g2t)
        return self

    def predict(self, data: np.ndarray, offsets: np.ndarray):
        """Per document: label (``und`` without letters), score, words, switches."""
        if self.book is None:
            self.book = cf.ScoreBook(self.scores, len(self.labels))
        n = len(offsets) - 1
        words = cf.LetterWords(data, offsets)
        count = np.bincount(words.doc, minlength=n)
        names = np.full(n, UNKNOWN, object)
        score, switches = np.zeros(n), np.zeros(n, np.int64)
        if len(words.doc) and self.labels:
            post = forward_backward(self.book.of(words)[words.distinct], self.trans, Pieces(words.doc))[0]
            mass = np.stack([np.bincount(words.doc, post[:, j], n) for j in range(len(self.labels))], 1)
            some = count > 0
            best = mass.argmax(axis=1)
            names[some] = np.array(self.labels, object)[best[some]]
            score[some] = np.clip(mass[some, best[some]] / count[some], 0, 1)
            label = post.argmax(axis=1)
            switch = (label[1:] != label[:-1]) & (words.doc[1:] == words.doc[:-1])
            switches = np.bincount(words.doc[1:][switch], minlength=n)
        return names, score, count, switches


def held_out(fold: int = 5, rest: int = 0) -> Column:
    """crc32 of the id as text, modulo ``fold``, equals ``rest``; a null id is
    not held out (and never learned from: ``fit_sample`` leaves it out)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == rest, F.lit(False))


def fit_sample(docs: DataFrame, label: Column, may_learn: Column, rows: int, chars: int,
               rare: int = RARE_DOCS) -> list[tuple[str, str]]:
    """(text, label) of at most ``rows`` labelled documents in hash order, up to
    ``rare`` of every label first: the ids are chosen on narrow columns, then their
    texts are read.  Both choices keep a bounded number of rows a task."""
    labelled = docs.select("doc_id", "text", label.alias("_label"), may_learn.alias("_may"))
    able = (labelled.where(F.col("_may") & F.col("_label").isNotNull() & F.col("doc_id").isNotNull())
            .select(F.col("doc_id").alias("_id"), "_label", F.xxhash64("doc_id", F.lit(11)).alias("_at")).distinct())
    of_label = W.partitionBy("_label").orderBy("_at", "_id")
    first = able.withColumn("_n", F.row_number().over(of_label)).where(F.col("_n") <= rare)
    first = first.select("_id", "_at", F.lit(0).alias("_turn"))
    rest = able.select("_id", "_at", F.lit(1).alias("_turn")).distinct().orderBy("_at", "_id").limit(rows)
    ids = (first.unionByName(rest).groupBy("_id", "_at").agg(F.min("_turn").alias("_turn"))
           .orderBy("_turn", "_at", "_id").limit(rows).select("_id"))
    picked = (labelled.join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))       # at most ``rows`` ids
              .where(F.col("text").isNotNull() & F.col("_label").isNotNull() & (F.length("text") <= chars))
              .select("doc_id", "text", "_label"))
    table = picked.orderBy("doc_id", "_label", "text").limit(rows).toArrow()
    return list(zip(table.column("text").to_pylist(), table.column("_label").to_pylist()))


def train(docs: DataFrame, may_learn: Column, rows: int = FIT_DOCS, chars: int = FIT_CHARS) -> Crf:
    """A model of the labelled documents (doc_id, text, lang) that ``may_learn`` selects."""
    sample = fit_sample(docs, F.col("lang").cast("string"), may_learn, rows, chars)
    return Crf(sorted({lang for _, lang in sample})).fit([t for t, _ in sample], [lang for _, lang in sample])


def _predictor(model: Crf):
    def run(batches):
        for batch in batches:
            data, offsets = bw.buffers(batch.column("text"))
            parts = [model.predict(d, o) for _, _, d, o in bw.blocks(data, offsets)]
            if parts:
                names, score, count, switches = (np.concatenate([p[i] for p in parts]) for i in range(4))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(names.tolist(), pa.string()), pa.array(score),
                     pa.array(count.astype(np.int64)), pa.array(switches.astype(np.int64))], names=PREDICTION.names)
    return run


def identify(docs: DataFrame, model: Crf) -> DataFrame:
    """One row per document: doc_id, lang_pred, score, n_words, n_switches.
    Reads ``doc_id`` and ``text`` only."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _predictor(model), PREDICTION)


def accept(docs: DataFrame, model: Crf, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents with a language: all columns, rows whose text is not
    ``und`` and scores at least ``min_score``.  One pass, no shuffle."""
    def run(batches):
        for batch in batches:
            data, offsets = bw.buffers(batch.column("text"))
            keep = [np.empty(0, bool)]
            for _, _, d, o in bw.blocks(data, offsets):
                names, score, _, _ = model.predict(d, o)
                keep.append((names != UNKNOWN) & (score >= min_score))
            yield batch.filter(pa.array(np.concatenate(keep)))
    return docs.mapInArrow(run, docs.schema)
