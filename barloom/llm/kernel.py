"""Vectorised text kernel: words, lines, hashes and n-grams of a batch of UTF-8 texts in numpy.

Texts come as one Arrow column.  All work is on its byte buffer, so no Python object is made per word.
ASCII classes on bytes equal the same classes on code points, since all bytes of a non-ASCII code point
are 0x80 or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are worked on at once; one longer text makes a slice of its own.
SLICE_BYTES = 4 << 20
LONG_WORD = 48
U = np.uint64
_MUL = U(0x9E3779B97F4A7C15)
_STEP = U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers, the same for the same seed."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * _MUL + U(seed)) | U(1)


_BYTE = constants(256, 11)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]

#: Bytes of a word: anything but ASCII white space; and ASCII letters, digits and all non-ASCII.
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


class Texts:
    """A slice of a batch: its bytes, and the bounds of each text in them."""

    def __init__(self, b: np.ndarray, off: np.ndarray, first: int):
        self.b, self.off, self.first, self.n = b, off, first, len(off) - 1

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        return span_sums(mask, self.off)

    def words(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and for each text the number of words before it."""
        m = table[self.b]
        n = len(m)
        bounds = self.off[(self.off > 0) & (self.off < n)]
        begin, end = m.copy(), m.copy()
        begin[1:] &= ~m[:-1]
        begin[bounds] |= m[bounds]
        end[:-1] &= ~m[1:]
        end[bounds - 1] |= m[bounds - 1]
        s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
        return s, e, np.searchsorted(s, self.off)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of all lines (split at \\n, the break left out) as starts and ends; for each text, the lines before it."""
        nl = np.flatnonzero(self.b == 10)
        per = np.searchsorted(nl, self.off)
        count = np.diff(per) + 1
        lo = np.concatenate([[0], np.cumsum(count)])
        s, e = np.empty(lo[-1], np.int64), np.empty(lo[-1], np.int64)
        s[lo[:-1]] = self.off[:-1]
        e[lo[1:] - 1] = self.off[1:]
        rest = np.ones(lo[-1], bool)
        rest[lo[:-1]] = False
        s[rest] = nl + 1
        rest = np.ones(lo[-1], bool)
        rest[lo[1:] - 1] = False
        e[rest] = nl
        return s, e, lo


def slices(column: pa.Array | pa.ChunkedArray) -> Iterator[Texts]:
    """Null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    b = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(off, off[at] + SLICE_BYTES, "right")) - 1)
        to = min(to, len(column))
        yield Texts(b[off[at] : off[to]], off[at : to + 1] - off[at], at)
        at = to


def span_sums(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


def word_hashes(b: np.ndarray, s: np.ndarray, e: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of byte spans; fold: as if A-Z were lower-case."""
    table, size = (_FOLDED if fold else _BYTE), e - s
    h = np.full(len(s), 7, U)
    with np.errstate(over="ignore"):
        live = np.arange(len(s))
        for k in range(min(int(size.max(initial=0)), LONG_WORD)):
            live = live[size[live] > k]
            h[live] = h[live] * _STEP + table[b[s[live] + k]]
        for i in np.flatnonzero(size > LONG_WORD):
            raw = b[s[i] : e[i]].tobytes()
            h[i] = xxhash.xxh64_intdigest(raw.lower() if fold else raw)
        return mix(h ^ size.astype(U))


def ngrams(h: np.ndarray, wo: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of k consecutive words inside one text, the index of their first word, and for each text the n-grams before it."""
    c = constants(k, 101 + k)
    n = max(0, len(h) - k + 1)
    ok = np.ones(len(h), bool)
    for j in range(1, k):
        at = wo[1:] - j
        ok[at[at >= wo[:-1]]] = False
    at = np.flatnonzero(ok[:n]) if n else np.empty(0, np.int64)
    at = at[at + k <= len(h)]
    with np.errstate(over="ignore"):
        g = np.zeros(n, U)
        for j in range(k):
            g += h[j : n + j] * c[j]
        g = mix(g)[at] if n else g
    return g, at, np.searchsorted(at, wo)


def owners(off: np.ndarray) -> np.ndarray:
    """For each item, the group that holds it, from the groups' bounds."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def repeated(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether an item's hash occurs twice or more in its group."""
    out = np.zeros(len(h), bool)
    if len(h) > 1:
        own = owners(off)
        with np.errstate(over="ignore"):
            key = mix(h + mix(own.astype(U) + U(1)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        out[order[1:]] |= same
        out[order[:-1]] |= same
    return out


def firsts(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One item of each distinct hash of each group."""
    out = np.ones(len(h), bool)
    if len(h) > 1:
        own = owners(off)
        with np.errstate(over="ignore"):
            key = mix(h + mix(own.astype(U) + U(1)))
        order = np.argsort(key)
        out[order[1:]] = key[order][1:] != key[order][:-1]
    return out
