"""Ranked lexical search by presence-mask grouping.

1. **Index.**  One pass over the texts counts each document's terms and keeps,
   for documents that hold a query term, the postings of the query terms.  A
   block of up to ``BLOCK_DOCS`` documents is one row of a written table: term
   by term the documents' numbers within the block and the occurrences.
2. **Statistics.**  Documents, terms and document frequencies are summed over the
   blocks; a term's weight and a document's length factor follow.
3. **Search.**  A task goes over its blocks with all items.  For an item it sets,
   per document, the bit of every term present: the presence mask.  Documents of
   equal mask form a group whose score is at most the sum of its terms' largest
   contributions in the block.  Groups are evaluated by descending maximum, and
   the item is safely finished when the next maximum is below its ``k``-th
   score so far.  That score is carried from block to block, and terms that
   cannot reach it even together open no documents (they are still scored).
4. The items' local lists (at most ``k`` rows a partition) meet in a window whose
   group limit cuts before the shuffle.

Items are the stated query set.  They are taken in blocks of bounded size
(``ITEM_BYTES`` of text), each broadcast; a table of any number of items is
several passes.  The documents are never joined with the items.

A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))); a document's score sums
weight * ((10^9 tf) div (1000 tf + 8 m)) over the item's terms, repeats included,
with m = 25 + (75 n N) div L.  Ties go to the smaller doc_id.

A null or empty text has no terms: such a document is never ranked, such an item
has no rows.  Rows that repeat a document are documents of their own.  A null
doc_id ranks after all others of its score.  Items equal in id and text are one;
items that share only the id are ranked apart.  Empty tables give no rows.  Only
doc_id, item_id and text are read, so other columns may have any name.  Very long
texts are counted piece by piece.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storecast.llm import bytewords as bw
from storecast.llm import pretoken as pt
from storecast.llm.common import saved
from storecast.llm.transducer import cut_at_blanks

TOP = 10
BLOCK_DOCS = 8192
PIECE_BYTES = 1 << 20
ITEM_BYTES = 8 << 20
# Terms are runs of ASCII letters and digits and of all other code points beyond ASCII.
_TERMS = bw.table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), fold=True)
_LOWER = (_TERMS - 1).astype(np.uint8)

BLOCKS = T.StructType([
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("sizes", T.BinaryType()),
    T.StructField("terms", T.BinaryType()), T.StructField("dfs", T.BinaryType()),
    T.StructField("members", T.BinaryType()), T.StructField("tfs", T.BinaryType()),
    T.StructField("n_docs", T.LongType()), T.StructField("n_terms", T.LongType())])
FOUND = T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", T.LongType()),
                      T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])


class Vocabulary:
    """The distinct terms of some texts, found again in a block's tokens."""

    def __init__(self, texts: list[str | None]):
        data, offsets = bw.buffers(pa.array(texts, pa.string()))
        t = bw.Tokens(data, offsets, _TERMS)
        low = _LOWER[data]
        words = [low[a:b].tobytes() for a, b in zip(t.start.tolist(), t.end.tolist())]
        number = {w: k for k, w in enumerate(dict.fromkeys(words))}
        #: (term numbers, repeats) of every text
        self.of_text = [np.unique(x, return_counts=True) for x in np.split(
            np.array([number[w] for w in words], np.int64), np.cumsum(t.counts())[:-1])] if texts else []
        self.n = len(number)
        hashes = np.zeros(self.n, np.uint64)
        hashes[[number[w] for w in words]] = t.hash
        self.order = np.argsort(hashes, kind="stable")
        self.keys = hashes[self.order]
        self.size = np.array([len(w) for w in number], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(number), np.uint8)

    def find(self, t: bw.Tokens, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which tokens are terms of the vocabulary, and which terms.  Words of
        the vocabulary that share a hash lie beside each other; all are tried."""
        at, term = [], []
        lo, hi = np.searchsorted(self.keys, t.hash, "left"), np.searchsorted(self.keys, t.hash, "right")
        token = np.flatnonzero(hi > lo)
        i = lo[token]
        while len(token):
            k = self.order[i]
            size = t.end[token] - t.start[token]
            same = np.flatnonzero(size == self.size[k])
            differ = (pt.ragged(low, t.start[token[same]], size[same])
                      != pt.ragged(self.bytes, self.start[k[same]], size[same]))
            if differ.any():
                same = same[~np.logical_or.reduceat(differ, np.cumsum(size[same]) - size[same])]
            at.append(token[same])
            term.append(k[same])
            more = i + 1 < hi[token]
            token, i = token[more], i[more] + 1
        return (np.concatenate(at), np.concatenate(term)) if at else (np.empty(0, np.int64), np.empty(0, np.int64))


def _indexer(vocab: Vocabulary, block_docs: int):
    def pieces(d, o):
        """(documents' numbers, bytes, offsets); a long document comes in pieces."""
        if len(o) > 2 or len(d) <= PIECE_BYTES:
            yield np.arange(len(o) - 1), d, o
        else:
            for p in cut_at_blanks(d, PIECE_BYTES):
                yield np.zeros(1, np.int64), p, np.array([0, len(p)])

    def row(held):
        """One block: ``held`` has, per run of documents, their ids and sizes and
        (document, term, occurrences)."""
        ids = [x for h in held for x in h[0]]
        base = np.cumsum([0] + [len(h[0]) for h in held])
        key = np.concatenate([h[3] * (1 << 32) + h[2] + b for h, b in zip(held, base)])
        order = np.argsort(key, kind="stable")
        key, tf = key[order], np.concatenate([h[4] for h in held])[order]
        term, member = key >> 32, key & 0xFFFFFFFF
        used, df = np.unique(term, return_counts=True)
        return [ids, np.concatenate([h[1] for h in held]).astype("<i8").tobytes(), used.astype("<u4").tobytes(),
                df.astype("<u4").tobytes(), member.astype("<u4").tobytes(), tf.astype("<u4").tobytes()]

    def batch_of(rows, n_docs, n_terms):
        cols = [[r[i] for r in rows] for i in range(6)] + [[n_docs] + [0] * (len(rows) - 1), [n_terms] + [0] * (len(rows) - 1)]
        kinds = [pa.list_(pa.int64())] + [pa.binary()] * 5 + [pa.int64()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=BLOCKS.names)

    def run(batches):
        held, count, n_docs, n_terms = [], 0, 0, 0
        nothing = [[], b"", b"", b"", b"", b""]
        for batch in batches:
            data, offsets = bw.buffers(batch.column("text"))
            ids = batch.column("doc_id")
            for lo, _, d, o in bw.blocks(data, offsets):
                n = len(o) - 1
                size, keys, tfs = np.zeros(n, np.int64), [], []
                for number, p, po in pieces(d, o):
                    t = bw.Tokens(p, po, _TERMS)
                    size[number] += t.counts()
                    at, term = vocab.find(t, _LOWER[p])
                    keys.append(number[t.doc[at]] * vocab.n + term)
                key, tf = np.unique(np.concatenate(keys), return_counts=True)
                n_docs += int((size > 0).sum())
                n_terms += int(size.sum())
                if not len(key):
                    continue
                doc, term = key // vocab.n, key % vocab.n
                docs, member = np.unique(doc, return_inverse=True)
                held.append((ids.take(pa.array(docs + lo)).to_pylist(), size[docs], member, term, tf))
                count += len(docs)
                if count >= block_docs:
                    yield batch_of([row(held)], n_docs, n_terms)
                    held, count, n_docs, n_terms = [], 0, 0, 0
        if held or n_docs:
            yield batch_of([row(held) if held else nothing], n_docs, n_terms)
    return run


def _df_counter(n: int):
    """Per partition: document frequencies by term, documents as -1, terms as -2."""
    def run(batches):
        df, docs, terms = np.zeros(n, np.int64), 0, 0
        for batch in batches:
            for r in batch.to_pylist():
                df[np.frombuffer(r["terms"], "<u4")] += np.frombuffer(r["dfs"], "<u4")
                docs += r["n_docs"]
                terms += r["n_terms"]
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, [-1, -2])),
                                          pa.array(np.append(df[used], [docs, terms]))], names=["term", "n"])
    return run


@dataclass
class Block:
    """One block's postings with the contribution of every posting."""
    ids: list
    cuts: dict[int, tuple[int, int]]
    members: np.ndarray
    parts: np.ndarray

    @staticmethod
    def read(row: dict, n_docs: int, n_terms: int) -> "Block":
        size = np.frombuffer(row["sizes"], "<i8")
        df = np.frombuffer(row["dfs"], "<u4").astype(np.int64)
        members = np.frombuffer(row["members"], "<u4").astype(np.int64)
        tf = np.frombuffer(row["tfs"], "<u4").astype(np.int64)
        if 75 * int(size.max(initial=0)) * n_docs < 1 << 63:
            m = 25 + 75 * size * n_docs // max(n_terms, 1)
        else:
            m = np.array([25 + 75 * s * n_docs // n_terms for s in size.tolist()], np.int64)
        end = np.cumsum(df).tolist()
        cuts = {t: (e - k, e) for t, e, k in zip(np.frombuffer(row["terms"], "<u4").tolist(), end, df.tolist())}
        return Block(row["doc_ids"], cuts, members, 1_000_000_000 * tf // (1000 * tf + 8 * m[members]))


class BestList:
    """The ``k`` best (score, doc_id) so far; a null id comes last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def least(self) -> int:
        """A document below this score cannot enter any more."""
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: list[int], ids: list) -> None:
        low = self.least()
        self.rows += [(s, i) for s, i in zip(scores, ids) if s >= low]
        self.rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        del self.rows[self.k:]


def search_block(block: Block, terms: np.ndarray, weights: np.ndarray, best: BestList) -> int:
    """Add a block's documents to an item's list; ``weights`` has the repeats in
    it.  Returns the number of documents scored."""
    here = [(block.cuts[t], w) for t, w in zip(terms.tolist(), weights.tolist()) if w and t in block.cuts]
    if not here:
        return 0
    # A term's largest contribution in the block, largest first.
    top = np.array([w * int(block.parts[a:b].max()) for (a, b), w in here], np.int64)
    order = np.argsort(-top, kind="stable")
    here, top = [here[i] for i in order], top[order]
    # Terms whose contributions together stay below the list's last score open no documents.
    rest = np.cumsum(top[::-1])[::-1]
    opening = int((rest >= best.least()).sum())
    if not opening:
        return 0
    docs = np.unique(np.concatenate([block.members[a:b] for (a, b), _ in here[:opening]]))
    # Presence masks, 64 terms a word.
    masks = np.zeros((len(docs), -(-len(here) // 64)), np.uint64)
    where = np.full(len(block.ids), -1, np.int64)
    where[docs] = np.arange(len(docs))
    for j, ((a, b), _) in enumerate(here):
        at = where[block.members[a:b]]
        masks[at[at >= 0], j // 64] |= np.uint64(1 << (j % 64))
    order = np.lexsort(masks.T)
    sorted_ = masks[order]
    first = np.flatnonzero(np.concatenate([[True], (sorted_[1:] != sorted_[:-1]).any(axis=1)]))
    ends = np.append(first[1:], len(order))
    bits = np.unpackbits(sorted_[first].astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, :len(here)]
    maximum = bits.astype(np.int64) @ top
    scored = 0
    turn = np.argsort(-maximum, kind="stable")
    at = 0
    while at < len(turn) and maximum[turn[at]] >= best.least():
        # The next masks by maximum, some at a time; none below the last score.
        take = [turn[at]]
        n, at = ends[take[0]] - first[take[0]], at + 1
        while at < len(turn) and n < 64 and maximum[turn[at]] >= best.least():
            take.append(turn[at])
            n, at = n + ends[turn[at]] - first[turn[at]], at + 1
        group = np.sort(docs[np.concatenate([order[first[g]:ends[g]] for g in take])])
        present = np.bitwise_or.reduce(bits[take], axis=0)
        score = np.zeros(len(group), np.int64)
        for j in np.flatnonzero(present).tolist():
            (a, b), w = here[j]
            i = np.minimum(np.searchsorted(block.members[a:b], group), b - a - 1)
            score += np.where(block.members[a + i] == group, w * block.parts[a + i], 0)
        best.add(score.tolist(), [block.ids[g] for g in group.tolist()])
        scored += len(group)
    return scored


def _searcher(shared, n_docs: int, n_terms: int, k: int):
    def run(batches):
        items = shared.value
        best = [BestList(k) for _ in items]
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.read(row, n_docs, n_terms)
                for (_, _, terms, weights), b in zip(items, best):
                    search_block(block, terms, weights, b)
        out = [(item, item_id, doc, score) for (item, item_id, _, _), b in zip(items, best) for score, doc in b.rows]
        cols = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=FOUND.names)
    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _search_items(docs: DataFrame, items: list[tuple[int, int | None, str]], k: int, block_docs: int) -> DataFrame:
    spark = docs.sparkSession
    vocab = Vocabulary([text for _, _, text in items])
    blocks = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                   .mapInArrow(_indexer(vocab, block_docs), BLOCKS), "search-blocks")
    # At most one row per term of the items at hand.
    sums = (blocks.select("terms", "dfs", "n_docs", "n_terms").mapInArrow(_df_counter(vocab.n), "term long, n long")
            .groupBy("term").agg(F.sum("n").alias("n")).toArrow())
    n = dict(zip(sums.column("term").to_pylist(), sums.column("n").to_pylist()))
    n_docs, n_terms = n.get(-1, 0), n.get(-2, 0)
    weights = np.array([weight(n_docs, n.get(t, 0)) for t in range(vocab.n)], np.int64)
    asked = [(number, item_id, terms, weights[terms] * repeats)
             for (number, item_id, _), (terms, repeats) in zip(items, vocab.of_text) if len(terms)]
    shared = spark.sparkContext.broadcast(asked)
    return blocks.mapInArrow(_searcher(shared, n_docs, n_terms, k), FOUND)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP, item_bytes: int = ITEM_BYTES,
                  block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The ``k`` best documents (doc_id, text) of every item (item_id, text):
    item_id, rank (from 1), doc_id, score."""
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // item_bytes)
    asked = saved(asked.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(parts, 1)))), "search-items")
    found = None
    for part in range(parts):
        rows = asked.where(F.col("part") == part).select("item_id", "text").toArrow().to_pylist()
        block = [((part << 32) + i, r["item_id"], r["text"]) for i, r in enumerate(rows)]
        some = saved(_search_items(docs, block, k, block_docs), "search-found")
        found = some if found is None else found.unionAll(some)
    if found is None:
        found = spark.createDataFrame([], FOUND)
    best_first = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))
