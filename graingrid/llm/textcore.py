"""Vectorised text primitives shared by the corpus operators.

Texts arrive as Arrow string arrays and are worked on as one flat byte buffer
with offsets, a block of a quarter megabyte at a time, so that no step loops
over characters or words in Python and memory stays bounded by the block or by
the longest single text. Nulls count as empty texts.

A word is a longest run of ASCII letters, digits and bytes from 0x80 up, after
case folding (ASCII, Latin-1 and basic Cyrillic letters). Word hashes are
64-bit polynomial hashes with a final mix; they are the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BLOCK_BYTES = 1 << 18

_WORD = np.zeros(256, bool)
for _r in ((48, 58), (97, 123), (128, 256)):
    _WORD[slice(*_r)] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C15)
_POW = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base modulo 2**64."""
    global _POW
    if len(_POW) < n:
        with np.errstate(over="ignore"):
            p = np.full(max(n, 64, 2 * len(_POW)), _BASE)
            p[0] = 1
            _POW = np.multiply.accumulate(p)
    return _POW[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> U(30)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def flat(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the offsets of its rows in them."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks != 1 else col.chunk(0)
    if pa.types.is_null(col.type):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if not len(col) or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(data: np.ndarray, off: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges (i, j) of at most ``size`` bytes, or of one longer row, with bytes and offsets."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII, Latin-1 and basic Cyrillic letters in UTF-8 bytes, length kept."""
    out = _FOLD[data]
    if len(out) < 2 or not (data >= 0xC3).any():
        return out
    lead, tail = data[:-1], data[1:]
    k = np.flatnonzero((lead == 0xC3) & (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)) + 1
    out[k] += 32
    k = np.flatnonzero((lead == 0xD0) & (tail >= 0x90) & (tail <= 0x9F)) + 1
    out[k] += 32
    k = np.flatnonzero((lead == 0xD0) & (tail >= 0xA0) & (tail <= 0xAF)) + 1
    out[k] -= 32
    out[k - 1] = 0xD1
    return out


class Words:
    """Words of some rows: ``start`` and ``end`` bytes, ``hash``, and ``ptr``, where each row's words begin."""

    __slots__ = ("start", "end", "hash", "ptr")

    def __init__(self, data: np.ndarray, off: np.ndarray):
        low = fold(data)
        is_word = _WORD[low]
        n = len(low)
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        before = np.zeros(n, bool)
        before[1:] = is_word[:-1]
        before &= ~edge[:-1]
        after = np.zeros(n, bool)
        after[:-1] = is_word[1:]
        after &= ~edge[1:]
        self.start = np.flatnonzero(is_word & ~before)
        self.end = np.flatnonzero(is_word & ~after) + 1
        self.ptr = np.searchsorted(self.start, off)
        self.hash = spans_hash(low, self.start, self.end)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


def spans_hash(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end), none of them empty."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    first = np.cumsum(size) - size
    rel = np.arange(int(size.sum())) - np.repeat(first, size)
    at = rel + np.repeat(start, size)
    return mix(np.add.reduceat(_BYTE[low[at]] * powers(int(size.max()))[rel], first))


def word_hash(word: str) -> int:
    """The hash that :class:`Words` gives the word."""
    b = fold(np.frombuffer(word.encode(), np.uint8))
    return int(spans_hash(b, np.array([0]), np.array([len(b)]))[0]) if len(b) else 0


def ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges [lo, hi): which range each element is of, and the element."""
    n = np.maximum(hi - lo, 0)
    who = np.repeat(np.arange(len(n)), n)
    return who, np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


class HashIndex:
    """A frozen open-addressing table from distinct 64-bit keys to their places, probed by whole arrays."""

    def __init__(self, keys: np.ndarray):
        keys = keys.astype(np.uint64)
        self.bits = max(10, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.val = np.full(1 << self.bits, -1, np.int32)
        todo = np.arange(len(keys))
        slot = self._slot(keys)
        self.probes = 1
        while len(todo):
            free = self.val[slot] < 0
            s, first = np.unique(slot[free], return_index=True)
            won = todo[free][first]
            self.keys[s], self.val[s] = keys[won], won
            left = self.val[slot] != todo
            todo, slot = todo[left], (slot[left] + 1) & ((1 << self.bits) - 1)
            self.probes += bool(len(todo))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        slot = self._slot(keys)
        val = self.val[slot]
        bad = np.flatnonzero((val >= 0) & (self.keys[slot] != keys))
        s = slot[bad]
        while len(bad):
            s = (s + 1) & ((1 << self.bits) - 1)
            v = self.val[s]
            val[bad] = v
            left = (v >= 0) & (self.keys[s] != keys[bad])
            bad, s = bad[left], s[left]
        return val


def as_longs(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)
