"""Word splitting and code lookup shared by the two BPE operators.

A block of texts is classified per code point (letter, number, white space,
other) and cut at class changes with the few extra rules of the tokenizers'
patterns, all as array operations.  Distinct words of a block are found by a
64-bit hash; a code book keeps the codes of words met before, in bounded memory,
and compares the bytes of every word it finds there.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

import numpy as np

from storecast.llm import bytewords as bw

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
# Code points with the Unicode property White_Space.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
               0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def class_table() -> np.ndarray:
    """Class of every code point."""
    names = "".join(map(unicodedata.category, map(chr, range(0x110000))))      # two characters each
    major = np.frombuffer(names.encode(), np.uint8)[::2]
    t = np.zeros(0x110000, np.uint8)
    t[major == ord("L")] = LETTER
    t[major == ord("N")] = NUMBER
    t[WHITE_SPACE] = SPACE
    return t


@functools.cache
def unassigned_table() -> np.ndarray:
    names = "".join(map(unicodedata.category, map(chr, range(0x110000))))
    return np.frombuffer(names.encode(), np.uint16) == int.from_bytes(b"Cn", "little")


def has_unassigned(cp: np.ndarray) -> bool:
    """Whether a code point is unassigned in Python's Unicode tables: a library
    with newer tables may know it as a letter, number or mark."""
    return bool(len(cp)) and int(cp.max()) >= 0x378 and bool(unassigned_table()[cp].any())


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the byte position of each (plus the end)."""
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    size = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    at = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    return cp, at


def _run_starts(kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Marks code points where the class changes or a document begins."""
    start = np.ones(len(kind), bool)
    start[1:] = kind[1:] != kind[:-1]
    start[first[first < len(kind)]] = True
    return start


def _contractions(cp: np.ndarray, kind: np.ndarray, start: np.ndarray, first: np.ndarray,
                  any_case: bool, after_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """Apostrophes that open 's 't 're 've 'm 'll 'd, and where each ends."""
    n = len(cp)
    x = np.flatnonzero((cp == 39) & start)
    if not len(x):
        return x, x
    doc_end = np.append(first[1:], n)[np.searchsorted(first, x, "right") - 1]
    low = np.append(cp, [0, 0])
    if any_case:
        low = np.where((low >= 65) & (low <= 90), low + 32, low)
    a, b = low[x + 1], low[x + 2]
    one = np.isin(a, [ord(c) for c in "stmd"]) & (x + 1 < doc_end)
    two = (((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l")))) \
        & (x + 2 < doc_end)
    if not after_space:
        spaced = (x > 0) & (cp[x - 1] == 32) & ~np.isin(x, first)
        one &= ~spaced
        two &= ~spaced
    hit = one | two
    return x[hit], x[hit] + np.where(one[hit], 2, 3)


def split_spaced(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the words of the byte-level pattern
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``;
    the words cover the whole text.  ``first``: first code point of each document."""
    n = len(cp)
    kind = class_table()[cp]
    run = _run_starts(kind, first)
    word = run.copy()
    x, end = _contractions(cp, kind, run, first, any_case=False, after_space=False)
    word[x + 1] = False
    word[end[end < n]] = True
    # The last white space before a word: a blank joins the word, others stand alone.
    is_doc = np.zeros(n + 1, bool)
    is_doc[first[first < n]] = True
    b = np.flatnonzero(run & (kind != SPACE))
    b = b[(b > 0)]
    b = b[(kind[b - 1] == SPACE) & ~is_doc[b]]
    word[b - 1] = True
    word[b[cp[b - 1] == 32]] = False
    return np.flatnonzero(word)


def split_bare(cp: np.ndarray, first: np.ndarray, kind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of the pattern
    ``'s|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+`` (letters of
    either case, white space dropped).  ``kind``: the code points' classes, where
    they differ from the table's."""
    n = len(cp)
    if kind is None:
        kind = class_table()[cp]
    run = _run_starts(kind, first)
    word = run | (kind == NUMBER)
    x, end = _contractions(cp, kind, run, first, any_case=True, after_space=True)
    word[x + 1] = False
    word[end[end < n]] = True
    starts = np.flatnonzero(word)
    ends = np.append(starts[1:], n)
    keep = kind[starts] != SPACE if n else np.empty(0, bool)
    return starts[keep], ends[keep]


SUMMED_BYTES = 1 << 20      # longest block hashed by running sums
_TABLE = 1 << 20            # powers held of each base and its inverse
_PRIMES = ((2 ** 31 - 1, 1_404_206_833), (2 ** 31 - 19, 902_763_517))       # (prime, base)


def _powers_modulo(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    filled = 1
    while filled < n:
        take = min(filled, n - filled)
        out[filled:filled + take] = out[:take] * np.uint64(pow(base, filled, prime)) % np.uint64(prime)
        filled += take
    return out


@functools.cache
def _power_tables() -> list[tuple[np.uint64, np.ndarray, np.ndarray]]:
    """Powers of each base and of its inverse modulo its prime."""
    return [(np.uint64(p), _powers_modulo(b, p, _TABLE), _powers_modulo(pow(b, -1, p), p, _TABLE))
            for p, b in _PRIMES]


def _polynomials(value: np.ndarray, lens: np.ndarray, prime: np.uint64, up: np.ndarray) -> np.ndarray:
    """Each span's polynomial modulo a prime; the spans lie end to end in
    ``value``.  Spans longer than the table of powers are summed piece by piece."""
    pieces = -(-lens // _TABLE)
    head = np.cumsum(pieces) - pieces
    span = np.repeat(np.arange(len(lens)), pieces)
    nth = np.arange(len(span)) - head[span]
    first = (np.cumsum(lens) - lens)[span] + nth * _TABLE
    size = np.minimum(lens[span] - nth * _TABLE, _TABLE)
    within = np.arange(len(value), dtype=np.int64) - np.repeat(first, size)
    h = np.add.reduceat(value * up[within], first) % prime
    if len(span) > len(lens):
        step = int(up[-1]) * int(up[1]) % int(prime)
        h = h * np.array([pow(step, k, int(prime)) for k in nth.tolist()], np.uint64) % prime
        h = np.add.reduceat(h, head) % prime
    return h


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lookup: np.ndarray) -> np.ndarray:
    """Hashes of byte spans (in order, not overlapping, none empty): polynomials
    modulo two primes.  Modulo a prime, unlike modulo a power of two, regular
    texts do not collide."""
    lens = end - start
    if not len(lens):
        return np.empty(0, np.uint64)
    h = np.zeros(len(lens), np.uint64)
    if len(data) <= SUMMED_BYTES:
        # A span's polynomial is a difference of running sums, shifted back to
        # position 0 by the inverse power of its start.  A sum stays below
        # 2^20 * 2^9 * 2^31.
        value = lookup[data].astype(np.uint64)
        total = np.zeros(len(data) + 1, np.uint64)
        for prime, up, down in _power_tables():
            np.cumsum(value * up[:len(data)], out=total[1:])
            h = h << np.uint64(32) ^ (total[end] - total[start]) % prime * down[start] % prime
    else:
        value = lookup[data if int(lens.sum()) == len(data) else ragged(data, start, lens)].astype(np.uint64)
        for prime, up, _ in _power_tables():
            h = h << np.uint64(32) ^ _polynomials(value, lens, prime, up)
    return bw.mix(h ^ lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def ragged(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices ``flat[start:start + length]`` end to end."""
    total = int(length.sum())
    if not total:
        return flat[:0]
    first = np.cumsum(length) - length
    return flat[np.arange(total, dtype=np.int64) + np.repeat(start - first, length)]


def joined(parts: list[np.ndarray], dtype) -> tuple[np.ndarray, np.ndarray]:
    """(all codes end to end, codes per word) of a list with one array a word."""
    if not parts:
        return np.empty(0, dtype), np.empty(0, np.int64)
    return np.concatenate(parts).astype(dtype), np.array([len(m) for m in parts], np.int64)


class CodeBook:
    """Codes of distinct words; ``encode`` gives the codes of a list of words end
    to end and the number of codes of each.  A word is looked up by its hash and
    taken only if its bytes (after ``fold``, a byte table) are equal; one that
    shares its hash with another is encoded by itself.  Holds at most ``limit``
    words and ``limit_bytes`` of their bytes; when it is full it starts anew,
    which costs time, never a result."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], dtype=np.int32,
                 limit: int = 600_000, fold: np.ndarray | None = None, limit_bytes: int = 64 << 20):
        self.encode, self.dtype, self.limit, self.limit_bytes = encode, dtype, limit, limit_bytes
        self.fold = None if fold is None else (fold - 1).astype(np.uint8)
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.at = np.empty(0, np.int64)
        self.size = np.empty(0, np.int64)
        self.flat = np.empty(1 << 16, self.dtype)
        self.used = 0
        self.raw_at = np.empty(0, np.int64)
        self.raw_size = np.empty(0, np.int64)
        self.raw = np.empty(1 << 16, np.uint8)
        self.raw_used = 0

    @staticmethod
    def _room(flat: np.ndarray, used: int, more: int) -> np.ndarray:
        if used + more <= len(flat):
            return flat
        out = np.empty(max(2 * len(flat), used + more), flat.dtype)
        out[:used] = flat[:used]
        return out

    def _add(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Encode words into ``flat``: (position, number of codes)."""
        flat, size = self.encode(words)
        self.flat = self._room(self.flat, self.used, len(flat))
        self.flat[self.used:self.used + len(flat)] = flat
        at = self.used + np.cumsum(size) - size
        self.used += len(flat)
        return at, size

    def codes(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray,
              end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``flat``, number of codes) for every span of ``data``."""
        if not len(hashes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        uniq, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > self.limit or self.raw_used > self.limit_bytes:
            self.clear()
        same = data if self.fold is None else self.fold[data]
        lens = end - start
        i = np.searchsorted(self.keys, uniq)
        known = np.zeros(len(uniq), bool)
        inside = i < len(self.keys)
        known[inside] = self.keys[i[inside]] == uniq[inside]
        new = np.flatnonzero(~known)
        if len(new):
            first = where[new]
            raw = data.tobytes()
            at, size = self._add([raw[s:e] for s, e in zip(start[first].tolist(), end[first].tolist())])
            kept = ragged(same, start[first], lens[first])
            self.raw = self._room(self.raw, self.raw_used, len(kept))
            self.raw[self.raw_used:self.raw_used + len(kept)] = kept
            raw_at = self.raw_used + np.cumsum(lens[first]) - lens[first]
            self.raw_used += len(kept)
            self.keys = np.insert(self.keys, i[new], uniq[new])
            self.at = np.insert(self.at, i[new], at)
            self.size = np.insert(self.size, i[new], size)
            self.raw_at = np.insert(self.raw_at, i[new], raw_at)
            self.raw_size = np.insert(self.raw_size, i[new], lens[first])
            i = np.searchsorted(self.keys, uniq)
        i = i[back]
        pos, size = self.at[i], self.size[i]
        differ = self.raw_size[i] != lens
        check = np.flatnonzero(~differ)
        unequal = ragged(same, start[check], lens[check]) != ragged(self.raw, self.raw_at[i[check]], lens[check])
        if unequal.any():
            differ[check] = np.logical_or.reduceat(unequal, np.cumsum(lens[check]) - lens[check])
        odd = np.flatnonzero(differ)
        if len(odd):
            words = [data[s:e].tobytes() for s, e in zip(start[odd].tolist(), end[odd].tolist())]
            number = {w: k for k, w in enumerate(dict.fromkeys(words))}
            at, n = self._add(list(number))
            which = np.array([number[w] for w in words], np.int64)
            pos[odd], size[odd] = at[which], n[which]
        return pos, size
