"""Vectorised word and line views of Arrow text columns.

A block is the UTF-8 bytes of some documents end to end plus their offsets.
Tokens are maximal runs of bytes that a 256-entry table maps above zero; they
never cross a document.  A token is known by a 64-bit hash of its mapped bytes,
so no Python string is made per word.  The hash multiplies a random number per
byte value by a random number per position (and per 64 KB piece), so that no
regular input, as a power series would allow, makes two tokens collide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BLOCK_BYTES = 1 << 19
_SPAN = 1 << 16


# What operators keep between the tasks of a Python worker.
_KEPT: list[dict] = []


def keep(table: dict) -> dict:
    """Register a table that ``release`` may empty."""
    _KEPT.append(table)
    return table


def release() -> None:
    """Give back the memory that other operators' tasks left in this worker."""
    for table in _KEPT:
        table.clear()
    pa.default_memory_pool().release_unused()


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_POSITION = mix(np.arange(1, _SPAN + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_SCATTER = mix(np.arange(257, dtype=U64) * U64(0xA0761D6478BD642F) + U64(0xE7037ED1A0B428DB))
_SCATTER[0] = 0


def run_hashes(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of runs that lie end to end in ``value`` (random numbers of their
    members), ``size`` members each and none empty."""
    if not len(size):
        return np.empty(0, U64)
    first = np.cumsum(size) - size
    within = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
    factor = _POSITION[within & (_SPAN - 1)]
    if int(size.max()) > _SPAN:
        factor = factor * (mix((within >> 16).astype(U64) + U64(0x589965CC75374CC3)) | U64(1))
    h = np.add.reduceat(value * factor, first)
    return mix(h ^ size.astype(U64) * U64(0xD6E8FEB86659FD93))


def table(separators: bytes = b" \t\n\v\f\r", fold: bool = False) -> np.ndarray:
    """Byte table: 0 for separators, byte value + 1 otherwise; ``fold`` maps
    A-Z to a-z."""
    t = np.arange(1, 257, dtype=np.uint16)
    if fold:
        t[ord("A"):ord("Z") + 1] = t[ord("a"):ord("z") + 1]
    t[list(separators)] = 0
    return t


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and its n + 1 offsets."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1] if n else np.zeros(1, np.int64)
    d = np.frombuffer(data, np.uint8)[o[0]:o[-1]] if data is not None and n else np.empty(0, np.uint8)
    return d, o - o[0]


def blocks(data: np.ndarray, offsets: np.ndarray,
           size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column into runs of whole documents of about ``size`` bytes:
    (first document, last + 1, bytes, offsets from 0)."""
    n = len(offsets) - 1
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


class Tokens:
    """Tokens of one block: ``start`` and ``end`` byte positions, ``doc`` index,
    64-bit ``hash``; ``value`` holds the mapped bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lookup: np.ndarray):
        n = len(data)
        value = lookup[data]
        inside = value != 0
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        cuts = offsets[1:-1]
        before[cuts[cuts < n]] = False
        after[cuts[cuts > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.n_docs = len(offsets) - 1
        lens = self.end - self.start
        self.hash = run_hashes(_SCATTER[value[inside]], lens)

    def counts(self) -> np.ndarray:
        """Tokens per document."""
        return np.bincount(self.doc, minlength=self.n_docs)


def grams(t: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``n``-token windows inside a document, and the index of
    each window's first token."""
    m = len(t.hash) - n + 1
    if m <= 0:
        return np.empty(0, U64), np.empty(0, np.int64)
    first = np.flatnonzero(t.doc[:m] == t.doc[n - 1:])
    h = np.zeros(m, U64)
    for j in range(n):
        h *= U64(0xC2B2AE3D27D4EB4F)
        h += t.hash[j:j + m]
    return mix(h[first]), first


def repeated(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries share their (document, key) with another entry, and which
    of them have an earlier equal one."""
    tagged = mix(key ^ mix(doc.astype(U64) + U64(1)))
    order = np.argsort(tagged, kind="stable")
    same = tagged[order][1:] == tagged[order][:-1]
    any_, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:][same]] = True
    any_[order[1:][same]] = True
    any_[order[:-1][same]] = True
    return any_, later
