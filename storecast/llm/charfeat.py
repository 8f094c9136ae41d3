"""Letter words of a block of texts and hashed character features of them.

Features are made once per distinct word of a block, as array operations.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

from storecast.llm import bytewords as bw
from storecast.llm import pretoken as pt

_C = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def lower_table() -> np.ndarray:
    """Simple lower case of every code point."""
    t = np.arange(0x110000, dtype=np.uint32)
    for cp in np.flatnonzero(pt.class_table() == pt.LETTER).tolist():
        low = chr(cp).lower()
        if len(low) == 1:
            t[cp] = ord(low)
    return t


class LetterWords:
    """Runs of letters, lower case: ``doc`` per word, ``distinct`` word numbers
    per word, and the distinct words' code points (``chars``, ``first``, ``size``)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        cp, at = pt.code_points(data)
        first_cp = np.searchsorted(at, offsets[:-1])
        kind = pt.class_table()[cp]
        run = pt._run_starts(kind, first_cp)
        starts = np.flatnonzero(run)
        ends = np.append(starts[1:], len(cp))
        letters = kind[starts] == pt.LETTER if len(cp) else np.empty(0, bool)
        starts, ends = starts[letters], ends[letters]
        low = lower_table()[cp].astype(np.uint64)
        size = ends - starts
        self.doc = np.searchsorted(first_cp, starts, "right") - 1
        # An empty document shares its first position with the next one.
        self.n_docs = len(offsets) - 1
        if len(starts):
            inner = np.cumsum(size) - size
            within = np.arange(int(size.sum())) - np.repeat(inner, size)
            chars = low[within + np.repeat(starts, size)]
            h = bw.run_hashes(bw.mix((chars + np.uint64(1)) * _C), size)
            self.hash, where, self.distinct = np.unique(h, return_index=True, return_inverse=True)
            self.size = size[where]
            self.chars = pt.ragged(low, starts[where], self.size)
        else:
            self.hash = np.empty(0, np.uint64)
            self.distinct = self.size = np.empty(0, np.int64)
            self.chars = np.empty(0, np.uint64)

    def subset(self, rows: np.ndarray) -> "LetterWords":
        """The distinct words ``rows`` alone (for making their features)."""
        out = object.__new__(LetterWords)
        start = np.cumsum(self.size) - self.size
        out.hash, out.size = self.hash[rows], self.size[rows]
        out.chars = pt.ragged(self.chars, start[rows], out.size)
        return out


def merged(texts: list[str]) -> LetterWords:
    """Words of many texts, made block by block so that only the words' numbers
    and the distinct words are held for all of them."""
    data, offsets = bw.buffers(pa.array(texts, pa.string()))
    parts = [(lo, LetterWords(d, o)) for lo, _, d, o in bw.blocks(data, offsets)]
    out = object.__new__(LetterWords)
    out.n_docs = len(texts)
    hashes = np.concatenate([w.hash for _, w in parts] or [np.empty(0, np.uint64)])
    sizes = np.concatenate([w.size for _, w in parts] or [np.empty(0, np.int64)])
    chars = np.concatenate([w.chars for _, w in parts] or [np.empty(0, np.uint64)])
    out.hash, where = np.unique(hashes, return_index=True)
    out.size = sizes[where]
    out.chars = pt.ragged(chars, (np.cumsum(sizes) - sizes)[where], out.size)
    out.doc = np.concatenate([w.doc.astype(np.int32) + lo for lo, w in parts] or [np.empty(0, np.int32)])
    out.distinct = np.concatenate([np.searchsorted(out.hash, w.hash).astype(np.int32)[w.distinct]
                                   for _, w in parts] or [np.empty(0, np.int32)])
    return out


class ScoreBook:
    """Scores of distinct words by hash, kept over the blocks of a worker.
    Holds at most ``limit`` words, then starts anew: never a different result."""

    def __init__(self, score, width: int, limit: int = 600_000):
        self.score, self.width, self.limit = score, width, limit
        self.keys = np.empty(0, np.uint64)
        self.rows = np.empty((0, width), np.float32)

    def of(self, words: LetterWords) -> np.ndarray:
        """One row of scores for every distinct word."""
        if len(self.keys) > self.limit:
            self.keys, self.rows = self.keys[:0], self.rows[:0]
        i = np.searchsorted(self.keys, words.hash)
        known = np.zeros(len(words.hash), bool)
        inside = i < len(self.keys)
        known[inside] = self.keys[i[inside]] == words.hash[inside]
        new = np.flatnonzero(~known)
        if len(new):
            made = self.score(words.subset(new)).reshape(len(new), self.width)
            self.keys = np.insert(self.keys, i[new], words.hash[new])
            self.rows = np.insert(self.rows, i[new], made, axis=0)
            i = np.searchsorted(self.keys, words.hash)
        return self.rows[i]


def features(words: LetterWords, bits: int, orders: tuple[int, ...], affixes: tuple[int, ...] = (),
             lexicon: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(feature, distinct word) pairs: character n-grams of ``^word$``, tagged
    prefixes and suffixes, and the word itself, hashed to ``2 ** bits``."""
    n = len(words.size)
    mask = np.uint64((1 << bits) - 1)
    if not n:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    size = words.size + 2
    first = np.cumsum(size) - size
    flat = np.zeros(int(size.sum()), np.uint64)
    who = np.repeat(np.arange(n), size)
    inner = np.ones(len(flat), bool)
    inner[first] = inner[first + size - 1] = False
    flat[inner] = words.chars
    flat[first], flat[first + size - 1] = 1, 2
    feats, owner = [], []

    def add(h, w, tag):
        feats.append((bw.mix(h ^ bw.mix(np.full(1, tag, np.uint64))) & mask).astype(np.int32))
        owner.append(w.astype(np.int32))

    h = np.zeros(len(flat), np.uint64)
    for k in range(1, max(orders) + 1):
        m = len(flat) - k + 1
        if m <= 0:
            break
        h = h[:m] * _C + flat[k - 1:]
        if k in orders:
            ok = np.flatnonzero(who[:m] == who[k - 1:])
            add(h[ok], who[ok], k)
    for k in affixes:
        for side, tag in ((0, 100 + k), (1, 200 + k)):
            long = np.flatnonzero(words.size >= k)
            at = first[long] + 1 if side == 0 else first[long] + size[long] - 1 - k
            g = np.zeros(len(long), np.uint64)
            for j in range(k):
                g = g * _C + flat[at + j]
            add(g, long, tag)
    if lexicon:
        add(words.hash, np.arange(n), 300)
    f, w = np.concatenate(feats), np.concatenate(owner)
    order = np.argsort(w, kind="stable")
    return f[order], w[order]


def summed(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``values`` summed by sorted ``owner`` (every owner present)."""
    cuts = np.searchsorted(owner, np.arange(n))
    return np.add.reduceat(values, cuts, axis=0) if n else np.zeros((0, *values.shape[1:]), values.dtype)
