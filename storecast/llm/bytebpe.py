"""Byte-level BPE encoding and decoding.

Two forms with equal results:

* ``encode`` / ``decode`` (used by the query and the pipeline): inside Arrow
  batches, texts are cut by the tokenizer's pattern with array operations, the
  distinct words of a batch are found, and the ranked merges are folded over the
  byte arrays of all new distinct words at once.  Decoding concatenates the
  binary pieces of the ids.
* ``ByteBPE`` (Spark higher-order functions only): ``regexp_extract_all`` cuts
  the words, ``aggregate`` folds the ranked merges over each word's byte array
  with the rank map as a literal of the plan.  Spark searches a map literal from
  end to end, so it is held as an array of small maps addressed by a hash; the
  most frequent words of a sample are encoded once and kept as a second literal.
  It takes about 175 microseconds for each word that is not in that table and
  could not meet the CPU limit (figures in the README), hence the first form.

No shuffle of texts or tokens in either form; a document is one row throughout.

A null text counts as empty: no ids, empty bytes.  Repeated rows are encoded one
by one; other columns are not read.  Texts are encoded whole.  Very long words
are merged through a heap, so a run of a million letters is not quadratic.
"""

from __future__ import annotations

import base64
import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storecast.llm import bytewords as bw
from storecast.llm import pretoken as pt

from storecast.llm.common import saved, text_or_empty

RANK_BUCKETS = 1 << 16
DICTIONARY_WORDS = 1 << 17     # most words kept as encoded (about 100 bytes each)
DICTIONARY_BUCKETS = 1 << 17
DICTIONARY_DOCS = 15_000       # documents (expected) whose words are counted for that
_NONE = 2_000_000_000


def read_ranks(path: str) -> list[tuple[str, int]]:
    """(bytes as hex, rank) of a tiktoken rank file."""
    out = []
    with open(path, "rb") as f:
        for line in f:
            token, rank = line.split()
            out.append((base64.b64decode(token).hex().upper(), int(rank)))
    return out


def java_pattern(pattern: str) -> str:
    """The word pattern with Unicode white space and classes in Java."""
    return "(?U)" + pattern


def hashed_map(entries: DataFrame, buckets: int) -> Column:
    """``entries`` (key, value strings), of bounded number, as a literal array
    of small maps; see ``lookup``.  The optimiser folds it to one value."""
    rows = entries.select("key", "value", _bucket(F.col("key"), buckets).alias("b")).toArrow()
    slots: list[dict] = [{} for _ in range(buckets)]
    for key, val, b in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2).to_pylist()):
        slots[b][key] = val
    return F.from_json(F.lit(json.dumps(slots, separators=(",", ":"), ensure_ascii=False)),
                       "array<map<string,string>>")


def _bucket(key: Column, buckets: int) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(buckets - 1)).cast("int")


def lookup(table: Column, buckets: int, key: Column) -> Column:
    """The value of ``key`` in a ``hashed_map``, or null."""
    return table[_bucket(key, buckets)][key]


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


class ByteBPE:
    """Encoder and decoder for one rank file and word pattern."""

    def __init__(self, spark: SparkSession, ranks_path: str, pattern: str):
        self.spark = spark
        self.pattern = java_pattern(pattern)
        ranks = read_ranks(ranks_path)
        entries = spark.createDataFrame(pa.table({"key": [k for k, _ in ranks],
                                                  "value": [str(r) for _, r in ranks]}))
        self.rank_map = hashed_map(entries, RANK_BUCKETS)
        pieces = [""] * (max(r for _, r in ranks) + 1)
        for k, r in ranks:
            pieces[r] = k
        self.pieces = F.split(F.lit(" ".join(pieces)), " ")
        self.words = None

    # -- words -------------------------------------------------------------
    def split(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))

    def fold(self, word: Column, ranks: Column) -> Column:
        """The ids of one word as decimals joined by commas: its rank if it is a
        token, else the fold of the ranked merges over its bytes.  ``ranks`` is
        the bound rank map."""
        return _let(F.hex(F.encode(word, "UTF-8")), lambda h: self._fold_hex(h, ranks))

    @staticmethod
    def _fold_hex(h: Column, ranks: Column) -> Column:
        def rank(piece: Column) -> Column:
            return lookup(ranks, RANK_BUCKETS, piece)

        def pair(left: Column, right: Column) -> Column:
            return F.coalesce(rank(F.concat(left, right)).cast("int"), F.lit(_NONE))

        n = (F.length(h) / 2).cast("int")
        nothing = F.array().cast("array<int>")

        def start(p: Column) -> Column:
            pairs = F.transform(F.sequence(F.lit(1), F.size(p) - 1),
                                lambda i: pair(F.element_at(p, i), F.element_at(p, i + 1)))
            return F.struct(p.alias("p"), pairs.alias("r"))

        def merge(state: Column, low: Column) -> Column:
            p, r = state["p"], state["r"]
            return _let(F.array_position(r, low).cast("int"), lambda k: _let(
                F.concat(F.element_at(p, k), F.element_at(p, k + 1)), lambda q: F.struct(
                    F.concat(F.slice(p, F.lit(1), k - 1), F.array(q), F.slice(p, k + 2, F.size(p))).alias("p"),
                    F.concat(F.slice(r, F.lit(1), F.greatest(k - 2, F.lit(0))),
                             F.when(k > 1, F.array(pair(p[k - 2], q))).otherwise(nothing),
                             F.when(k + 1 < F.size(p), F.array(pair(q, p[k + 1]))).otherwise(nothing),
                             F.slice(r, k + 2, F.size(p))).alias("r"))))

        def step(state: Column, _: Column) -> Column:
            return _let(F.coalesce(F.array_min(state["r"]), F.lit(_NONE)), lambda low: F.when(
                low == _NONE, state).otherwise(merge(state, low)))

        bytes_ = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(h, 2 * i + 1, 2))
        merged = F.aggregate(F.sequence(F.lit(1), n - 1), _let(bytes_, start), step,
                             lambda s: F.array_join(F.transform(s["p"], rank), ","))
        return F.coalesce(rank(h), merged)

    def learn_words(self, docs: DataFrame, words: int = DICTIONARY_WORDS,
                    sample: int = DICTIONARY_DOCS) -> "ByteBPE":
        """Encode the most frequent distinct words of a sample of documents once
        and keep them as a literal.  Affects speed only."""
        n = docs.count()
        some = docs.sample(min(1.0, sample / max(1, n)), seed=5) if n > sample else docs
        counted = (some.select(F.explode(self.split(text_or_empty())).alias("key"))
                   .groupBy("key").agg(F.count("*").alias("n")))
        top = saved(counted.orderBy(F.desc("n"), "key").limit(words), "bpe-words")
        encoded = saved(top.repartition(64).select(
            "key", _let(self.rank_map, lambda ranks: self.fold(F.col("key"), ranks)).alias("value")), "bpe-codes")
        self.words = hashed_map(encoded, DICTIONARY_BUCKETS)
        return self

    def encode(self, text: Column) -> Column:
        """Decimal ids of a text joined by commas (empty text: empty string)."""
        def ids(ranks: Column, known: Column | None) -> Column:
            def code(w: Column) -> Column:
                if known is None:
                    return self.fold(w, ranks)
                return F.coalesce(lookup(known, DICTIONARY_BUCKETS, w), self.fold(w, ranks))
            return F.array_join(F.transform(self.split(text), code), ",")

        if self.words is None:
            return _let(self.rank_map, lambda ranks: ids(ranks, None))
        return _let(self.rank_map, lambda ranks: _let(self.words, lambda known: ids(ranks, known)))

    # -- ids back to bytes ---------------------------------------------------
    def decode(self, ids: Column) -> Column:
        """The bytes of decimal ids joined by commas: the pieces' bytes end to
        end (joined as hexadecimal text, so the cost is linear)."""
        none = F.lit("").cast("binary")
        joined = _let(self.pieces, lambda pieces: F.array_join(
            F.transform(F.split(ids, ","), lambda i: pieces[i.cast("int")]), ""))
        return F.when(ids == "", none).otherwise(F.unhex(joined))


# -- the batch form ----------------------------------------------------------

LONG_WORD = 400        # bytes; longer words are merged one by one through a heap
ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
_SHIFT = 20            # ids fit in 20 bits


class RankedMerges:
    """Folds ranked merges over many words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << _SHIFT | right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << _SHIFT | right
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.values[i], _NONE)

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(words)
        todo = []
        for i, w in enumerate(words):
            whole = self.ranks.get(w)
            if whole is not None:
                out[i] = np.array([whole], np.int32)
            elif len(w) > LONG_WORD:
                out[i] = self._one(w)
            else:
                todo.append(i)
        if todo:
            for i, ids in zip(todo, self._fold([words[i] for i in todo])):
                out[i] = ids
        return out

    def _fold(self, words: list[bytes]) -> list[np.ndarray]:
        """All words step by step: in each step every word joins its leftmost
        pair of lowest rank; words without such a pair are finished."""
        done: list[np.ndarray] = [None] * len(words)
        ids = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        size = np.array([len(w) for w in words], np.int64)
        who = np.arange(len(words))
        while len(who):
            first = np.cumsum(size) - size
            last = np.zeros(len(ids), bool)
            last[first + size - 1] = True
            rank = np.full(len(ids), _NONE, np.int64)
            inner = np.flatnonzero(~last)
            rank[inner] = self._rank_of(ids[inner], ids[inner + 1])
            best = np.minimum.reduceat(rank << 32 | np.arange(len(ids)), first)
            low, at = best >> 32, best & 0xFFFFFFFF
            end = low == _NONE
            for w, f, n in zip(who[end].tolist(), first[end].tolist(), size[end].tolist()):
                done[w] = ids[f:f + n].astype(np.int32)
            go = ~end
            ids[at[go]] = low[go]
            keep = np.repeat(go, size)
            keep[at[go] + 1] = False
            ids, who, size = ids[keep], who[go], size[go] - 1
        return done

    def _one(self, word: bytes) -> np.ndarray:
        """One long word: linked list of pieces and a heap of ranked pairs."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def push(i):
            j = after[i]
            if j < n:
                r = self.pairs.get(ids[i] << _SHIFT | ids[j])
                if r is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                push(before[i])
            push(i)
        return np.array([x for x in ids if x >= 0], np.int32)


_CODERS: dict[int, tuple] = bw.keep({})   # one per worker process and rank table


def _whole(ranks: dict[bytes, int], documents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Documents by the tiktoken library (for code points that its Unicode
    tables know and Python's do not)."""
    import public_tokenizers
    import tiktoken
    coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return pt.joined([np.array(coder.encode_ordinary(t.decode()), np.int32) for t in documents], np.int32)


def _encoder(ranks: dict[bytes, int], tag: int):
    def run(batches):
        book = _CODERS.get(tag)
        if book is None:
            _CODERS.clear()
            merges = RankedMerges(ranks)
            book = _CODERS[tag] = pt.CodeBook(lambda words: pt.joined(merges.encode(words), np.int32))
        every = bw.table(b"")
        for batch in batches:
            data, offsets = bw.buffers(batch.column("text"))
            flat, sizes = [], []
            for _, _, d, o in bw.blocks(data, offsets):
                cp, at = pt.code_points(d)
                if pt.has_unassigned(cp):
                    ids, size = _whole(ranks, [d[a:b].tobytes() for a, b in zip(o[:-1].tolist(), o[1:].tolist())])
                    flat.append(ids)
                    sizes.append(size)
                    continue
                first = np.searchsorted(at, o[:-1])
                start = at[pt.split_spaced(cp, first)]
                end = np.append(start[1:], len(d))
                pos, size = book.codes(pt.span_hashes(d, start, end, every), d, start, end)
                flat.append(pt.ragged(book.flat, pos, size))
                total = np.concatenate([[0], np.cumsum(size)])
                edge = total[np.searchsorted(start, o)]
                sizes.append(np.diff(edge))
            if not flat:
                continue
            offs = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(flat)))],
                names=ENCODED.names)
    return run


def _pieces(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes end to end, with start and size by id."""
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    size = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size


def decode_column(ids: pa.ListArray, pieces) -> pa.Array:
    """The pieces' bytes of every row's ids, end to end."""
    flat, start, size = pieces
    offs = ids.offsets.to_numpy().astype(np.int64)
    values = ids.values.to_numpy()[offs[0]:offs[-1]]
    cells = np.concatenate([[0], np.cumsum(size[values])])[offs - offs[0]].astype(np.int32)
    data = pt.ragged(flat, start[values], size[values])
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(cells), pa.py_buffer(data)])


def read_rank_dict(path: str) -> dict[bytes, int]:
    return {bytes.fromhex(k): r for k, r in read_ranks(path)}


def encode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and ids (array of int) of every row."""
    ranks = read_rank_dict(ranks_path)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _encoder(ranks, hash(frozenset(ranks.items()))), ENCODED)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` (with an ``ids`` array) plus ``decoded`` (binary)."""
    pieces = _pieces(read_rank_dict(ranks_path))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, decode_column(batch.column("ids"), pieces)],
                                             names=[*batch.schema.names, "decoded"])
    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))


def encode_decode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, ids, and decoded: the bytes read back from those ids.  Encoder and
    decoder run in one pass, so a task needs one Python worker."""
    ranks = read_rank_dict(ranks_path)
    coder, pieces = _encoder(ranks, hash(frozenset(ranks.items()))), _pieces(ranks)

    def run(batches):
        for batch in coder(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, decode_column(batch.column("ids"), pieces)],
                                             names=[*ENCODED.names, "decoded"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, T.StructType([*ENCODED.fields, T.StructField("decoded", T.BinaryType())]))
