"""BPE encoding by a streaming transducer with bounded lookahead, and decoding
with an incremental byte-to-text state machine.

**Lookahead.**  The merge list is proper if every merge joins symbols that
earlier merges (or no merges) made.  For such a list, whether a token ends at a
place depends on boundedly many symbols to its right.  ``sufficient_lookahead``
computes a bound in one pass over the merges in rank order.  ``need[t]`` is how
far beyond its right end one must look to know whether ``t`` stands there before
the merge at hand.  A merge (u, v) of rank r makes

* ``u`` depend on ``v`` not following: ``size(v) + need[v]``;
* ``v`` depend on ``u`` not preceding: ``need[u] - size(v)``;
* ``uv`` depend on both: ``need[v]`` and ``need[u] - size(v)``,

each an upper bound, kept as a maximum.  The largest ``need`` after the last
merge is the lookahead K.  A list that is not proper has none and is refused.

**Encoding.**  A word is a stream of symbols (bytes; the last one marked as the
word's end).  The transducer holds a window of at most ``window`` symbols (a
multiple of K plus the longest token).  It folds the ranked merges within the
window, emits every token that ends at least K symbols before the window's end
(all tokens once the word's end is in the window), and starts the next window
at the last emitted token's end; tokens on either side of a token boundary are
made independently, so nothing else is carried over.  Memory is constant in the
length of a word.  ``encode`` advances many words in lockstep as array
operations; ``Stream`` takes one word in pieces.  Within a block, distinct words
are encoded once.

**Text.**  Documents are handled in pieces cut before ASCII blanks, where no
word, normalisation or special token reaches across.  Words are the matches of
the tokenizer's own pattern in the normalised text.  A code point that Python's
Unicode tables do not know yet is classed, and its text normalised, by asking
the tokenizer's normaliser and pre-tokenizer.

**Decoding.**  Ids become byte pieces, joined by the separator (the file has no
decoder, so a blank, as in the library); a state machine turns them into text
piece by piece and holds back an unfinished code point.  Bytes that no text has
become U+FFFD.  With ``plain=True`` the pieces are the words' own bytes and a word end is a
blank.

A null or empty text has no ids and decodes to an empty text.  Very long texts
and words are handled whole.  Repeated rows are encoded each, null doc_ids are
kept, an empty table gives no rows.  Only doc_id and text are read, so other
columns may have any name.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storecast.llm import bytewords as bw
from storecast.llm import pretoken as pt

PIECE_BYTES = 1 << 20       # text handled at once
_BITS = 20                  # ids fit in 20 bits
_NONE = np.int64(1 << 30)
_FOLD = bw.table(b"", fold=True)

CODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
                      T.StructField("decoded", T.StringType())])


@functools.cache
def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself,
    the rest from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)]


def sufficient_lookahead(merges: Iterable[tuple[str, str]], size) -> int:
    """Symbols to the right of a token that settle it; ``size(t)``: symbols of a
    token.  Raises ValueError if the list is not proper."""
    merges = list(merges)
    made = {u + v: r for r, (u, v) in reversed(list(enumerate(merges)))}
    need: dict[str, int] = {}
    for r, (u, v) in enumerate(merges):
        if made.get(u, -1) >= r or made.get(v, -1) >= r:
            raise ValueError(f"merge {r} joins a symbol that a later merge makes: no bounded lookahead")
        nu, nv, n = need.get(u, 0), need.get(v, 0), size(v)
        both = max(nv, nu - n)
        need[u + v] = max(need.get(u + v, 0), both)
        need[u] = max(nu, n + nv)
        need[v] = max(need.get(v, 0), both)
    return max(need.values(), default=0)


class Merges:
    """A tokenizer file's merge list as arrays, with its lookahead."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocab = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        chars = byte_characters()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + self.suffix] for c in chars], np.int64)
        self.lookahead = sufficient_lookahead(merges, lambda t: len(t.removesuffix(self.suffix)))
        self.longest = max(len(t.removesuffix(self.suffix)) for t in vocab)
        self.window = 2 * (self.lookahead + self.longest) + 64
        keys = np.array([vocab[u] << _BITS | vocab[v] for u, v in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.joined = np.array([vocab[u + v] for u, v in merges], np.int64)
        self.token = [""] * (max([*vocab.values(), *self.specials.values()]) + 1)
        for t, i in [*vocab.items(), *self.specials.items()]:
            self.token[i] = t
        self.width = np.array([len(t.removesuffix(self.suffix)) for t in self.token], np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << _BITS | right
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.ranks[i], _NONE)


class Transducer:
    """Encodes words window by window."""

    SHORT = 96      # windows up to this long are folded together as arrays, longer ones through a heap

    def __init__(self, merges: Merges):
        self.m = merges
        # Ranks of pairs of single symbols, inner-inner and inner-final.
        left = np.repeat(merges.inner, 256)
        self.first = np.stack([merges.rank_of(left, np.tile(merges.inner, 256)),
                               merges.rank_of(left, np.tile(merges.final, 256))]).reshape(2, 256, 256)
        self.pairs = dict(zip(merges.keys.tolist(), merges.ranks.tolist()))

    def _symbols(self, raw: np.ndarray, size: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol ids of windows end to end, and which symbols close a word."""
        closing = np.zeros(len(raw), np.int64)
        closing[(np.cumsum(size) - 1)[ends]] = 1
        return np.where(closing == 1, self.m.final[raw], self.m.inner[raw]), closing

    def _fold(self, raw: np.ndarray, size: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Ranked merges within windows that lie end to end in ``raw`` (bytes),
        ``size`` symbols each; ``ends``: the window holds its word's end.  In a
        step every window joins its leftmost pair of lowest rank."""
        ids, closing = self._symbols(raw, size, ends)
        rank = np.full(len(raw), _NONE, np.int64)
        rank[:-1] = self.first[closing[1:], raw[:-1], raw[1:]]
        rank[np.cumsum(size) - 1] = _NONE
        out: list[np.ndarray] = [ids[:0]] * len(size)
        who = np.arange(len(size))
        while len(who):
            first = np.cumsum(size) - size
            best = np.minimum.reduceat(rank << 32 | np.arange(len(ids)), first)
            low, at = best >> 32, best & 0xFFFFFFFF
            go = low < _NONE
            for w, f, k in zip(who[~go].tolist(), first[~go].tolist(), size[~go].tolist()):
                out[w] = ids[f:f + k]
            at, first, end, who = at[go], first[go], (first + size - 1)[go], who[go]
            ids[at] = self.m.joined[low[go]]
            # The joined symbol's pairs with its neighbours; the symbol after it goes.
            rank[at] = _NONE
            x = at[at + 2 <= end]
            rank[x] = self.m.rank_of(ids[x], ids[x + 2])
            x = at[at > first]
            rank[x - 1] = self.m.rank_of(ids[x - 1], ids[x])
            keep = np.repeat(go, size)
            keep[at + 1] = False
            ids, rank, size = ids[keep], rank[keep], size[go] - 1
        return out

    def _fold_one(self, raw: np.ndarray, ends: bool) -> np.ndarray:
        """The same for one window: a linked list and a heap of ranked pairs."""
        ids = self._symbols(raw, np.array([len(raw)]), np.array([ends]))[0].tolist()
        n, pairs, joined = len(ids), self.pairs, self.m.joined
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1)
                if (r := pairs.get(ids[i] << _BITS | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = int(joined[r]), -1
            after[i] = j = after[j]
            if j < n:
                before[j] = i
                if (r := pairs.get(ids[i] << _BITS | ids[j])) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[j]))
            j = before[i]
            if j >= 0 and (r := pairs.get(ids[j] << _BITS | ids[i])) is not None:
                heapq.heappush(heap, (r, j, ids[j], ids[i]))
        return np.array([x for x in ids if x >= 0], np.int64)

    def stable(self, raw: np.ndarray, ends: bool) -> np.ndarray:
        """Tokens of one window that nothing to its right can change."""
        ids = self._fold_one(raw, ends)
        return ids if ends else ids[np.cumsum(self.m.width[ids]) <= len(raw) - self.m.lookahead]

    def _long(self, word: bytes) -> np.ndarray:
        stream = Stream(self)
        out = [stream.feed(word[lo:lo + PIECE_BYTES]) for lo in range(0, len(word), PIECE_BYTES)]
        return np.concatenate([*out, stream.finish()])

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (none empty) end to end, and how many each has.  A short
        word's end lies in its first window, so all its tokens are stable at once."""
        size = np.array([len(w) for w in words], np.int64)
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(words)
        short = np.flatnonzero(size <= self.SHORT)
        if len(short):
            raw = np.frombuffer(b"".join(words[i] for i in short.tolist()), np.uint8)
            for i, ids in zip(short.tolist(), self._fold(raw, size[short], np.ones(len(short), bool))):
                out[i] = ids
        for i in np.flatnonzero(size > self.SHORT).tolist():
            out[i] = self._long(words[i])
        return pt.joined(out, np.int32)


class Stream:
    """One word, given in pieces: ``feed`` returns the ids that have become
    stable, ``finish`` the rest.  Holds at most a window and the piece given."""

    def __init__(self, transducer: Transducer):
        self.t, self.held = transducer, np.empty(0, np.uint8)

    def _step(self, ends: bool) -> np.ndarray:
        ids = self.t.stable(self.held[:self.t.m.window], ends)
        self.held = self.held[int(self.t.m.width[ids].sum()):]
        return ids

    def feed(self, piece: bytes) -> np.ndarray:
        self.held = np.concatenate([self.held, np.frombuffer(piece, np.uint8)])
        out = [np.empty(0, np.int64)]
        while len(self.held) > self.t.m.window:     # so no symbol of the window ends the word
            out.append(self._step(False))
        return np.concatenate(out)

    def finish(self) -> np.ndarray:
        out = [np.empty(0, np.int64)]
        while len(self.held) > self.t.m.window:
            out.append(self._step(False))
        if len(self.held):
            out.append(self._step(True))
        return np.concatenate(out)


class Encoder:
    """Ids of whole texts."""

    def __init__(self, tokenizer_json: str):
        self.json = tokenizer_json
        self.m = Merges(tokenizer_json)
        self.transducer = Transducer(self.m)
        self.book = pt.CodeBook(lambda words: self.transducer.encode([self._lower(w) for w in words]),
                                np.int32, fold=_FOLD)
        self.special = re.compile("|".join(map(re.escape, sorted(self.m.specials, key=len, reverse=True)))
                                  or r"(?!)")
        self._tokenizer, self._classes = None, {}

    @staticmethod
    def _lower(word: bytes) -> bytes:
        """Lower case code point by code point (no rule looks at neighbours)."""
        return word.lower() if word.isascii() else "".join(map(str.lower, word.decode())).encode()

    def _library(self):
        if self._tokenizer is None:
            from tokenizers import Tokenizer
            self._tokenizer = Tokenizer.from_str(self.json)
        return self._tokenizer

    def _plain(self, text: bytes) -> bool:
        """Whether the words of the text as it stands are those of its normal form."""
        if any(s.encode() in text for s in self.m.specials):
            return False
        if text.isascii():
            return True
        t = text.decode()
        return "\u0130" not in t and unicodedata.is_normalized("NFC", t) and not pt.has_unassigned(
            np.frombuffer(t.encode("utf-32-le"), np.uint32))

    def _class(self, c: int) -> int:
        """Class of a code point that Python does not know, from the pre-tokenizer's cuts."""
        if c not in self._classes:
            cuts = self._library().pre_tokenizer.pre_tokenize_str
            inner = len(cuts(f"a{chr(c)}a"))
            self._classes[c] = (pt.LETTER if inner == 1 else pt.SPACE if inner == 2 else
                                pt.OTHER if len(cuts(f".{chr(c)}")) == 1 else pt.NUMBER)
        return self._classes[c]

    def _spans(self, d: np.ndarray, o: np.ndarray, known: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, ids per document) of texts in normal form but for case."""
        cp, at = pt.code_points(d)
        kind = pt.class_table()[cp]
        if not known:
            odd = np.flatnonzero(pt.unassigned_table()[cp])
            kind[odd] = [self._class(c) for c in cp[odd].tolist()]
        s, e = pt.split_bare(cp, np.searchsorted(at, o[:-1]), kind)
        start, end = at[s], at[e]
        pos, size = self.book.codes(pt.span_hashes(d, start, end, _FOLD), d, start, end)
        total = np.concatenate([[0], np.cumsum(size)])
        return pt.ragged(self.book.flat, pos, size), np.diff(total[np.searchsorted(start, o)])

    def _general(self, text: str) -> np.ndarray:
        """One text that holds special tokens or is not in normal form."""
        out, at = [np.empty(0, np.int32)], 0
        for hit in [*self.special.finditer(text), None]:
            part = text[at:hit.start() if hit else len(text)]
            known = not pt.has_unassigned(np.frombuffer(part.encode("utf-32-le"), np.uint32))
            part = ("".join(map(str.lower, unicodedata.normalize("NFC", part))) if known
                    else self._library().normalizer.normalize_str(part))
            raw = np.frombuffer(part.encode(), np.uint8)
            if len(raw):
                out.append(self._spans(raw, np.array([0, len(raw)]), known)[0])
            if hit:
                out.append(np.array([self.m.specials[hit.group()]], np.int32))
                at = hit.end()
        return np.concatenate(out)

    def block(self, d: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, ids per document) of some whole documents or pieces."""
        if self._plain(d.tobytes()):
            return self._spans(d, o)
        flat, size = [np.empty(0, np.int32)], []
        for a, b in zip(o[:-1].tolist(), o[1:].tolist()):
            text = d[a:b].tobytes()
            ids = self._spans(d[a:b], np.array([0, b - a]))[0] if self._plain(text) else self._general(text.decode())
            flat.append(ids)
            size.append(len(ids))
        return np.concatenate(flat), np.array(size, np.int64)

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same for a whole column, block by block; a long document is
        encoded piece by piece."""
        for _, _, d, o in bw.blocks(data, offsets, PIECE_BYTES):
            if len(o) > 2 or len(d) <= PIECE_BYTES:
                yield self.block(d, o)
            else:
                ids = np.concatenate([self.block(p, np.array([0, len(p)]))[0] for p in cut_at_blanks(d)])
                yield ids, np.array([len(ids)], np.int64)


def cut_at_blanks(d: np.ndarray, size: int = PIECE_BYTES) -> Iterator[np.ndarray]:
    """Pieces of about ``size`` bytes that begin at an ASCII blank (longer where
    none is near)."""
    blank = np.flatnonzero((d == 32) | ((d >= 9) & (d <= 13)))
    lo = 0
    while lo < len(d):
        k = np.searchsorted(blank, lo + size)
        hi = int(blank[k]) if k < len(blank) else len(d)
        yield d[lo:hi]
        lo = hi


class Decoder:
    """Ids to text, incrementally.  ``plain``: the words' own text instead of
    the token strings."""

    def __init__(self, merges: Merges, separator: str = " ", plain: bool = False):
        if plain:
            of = {c: b for b, c in enumerate(byte_characters())}
            pieces = [t.encode() if t in merges.specials else bytes(of[c] for c in t.removesuffix(merges.suffix))
                      + (b" " if merges.suffix and t.endswith(merges.suffix) else b"") for t in merges.token]
            separator = ""
        else:
            pieces = [(separator + t).encode() for t in merges.token]
        self.skip = len(separator.encode())
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.begin()

    def begin(self) -> "Decoder":
        """Ready for the next text."""
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")
        self.at_start = True
        return self

    def feed(self, ids: np.ndarray) -> str:
        """Text that the ids complete."""
        data = pt.ragged(self.bytes, self.start[ids], self.size[ids]).tobytes()
        if self.at_start and len(ids):
            data, self.at_start = data[self.skip:], False
        return self.machine.decode(data)

    def finish(self) -> str:
        return self.machine.decode(b"", True)

    def text(self, ids: np.ndarray, step: int = 1 << 18) -> str:
        self.begin()
        return "".join([self.feed(ids[lo:lo + step]) for lo in range(0, len(ids), step)] + [self.finish()])


_CODERS: dict[int, tuple[Encoder, Decoder]] = {}    # one per worker process and tokenizer


def coder(tokenizer_json: str) -> tuple[Encoder, Decoder]:
    """The worker process's encoder and decoder, kept between tasks."""
    tag = hash(tokenizer_json)
    if tag not in _CODERS:
        _CODERS.clear()
        encoder = Encoder(tokenizer_json)
        _CODERS[tag] = encoder, Decoder(encoder.m)
    return _CODERS[tag]


def encode_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids, and decoded: the text read back from those ids.  One pass, no
    shuffle."""
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)       # fixed size

    def run(batches):
        encoder, decoder = coder(shared.value)
        for batch in batches:
            data, offsets = bw.buffers(batch.column("text"))
            at = 0
            for ids, size in encoder.documents(data, offsets):
                cut = np.concatenate([[0], np.cumsum(size)])
                text = [decoder.text(ids[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(size)),
                     pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids.astype(np.int32))),
                     pa.array(text, pa.string())], names=CODED.names)
                at += len(size)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, CODED)
