"""Vectorised text primitives over Arrow string columns.

A batch of texts is one UTF-8 buffer with offsets; words, hashes and counts are numpy passes over pieces
of about ``CHUNK`` bytes, so memory stays bounded however long a batch is. A single text is never split.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
SPACES = b" \t\n\x0b\x0c\r"
U64 = np.uint64

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_BASE, _STEP = U64(0x9E3779B97F4A7C15), U64(0xD1342543DE82EF95)
NONSPACE = np.ones(256, bool)
NONSPACE[list(SPACES)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def trim() -> None:
    """Give memory that is free back to the system. Workers live on from task to task, and would each keep the most they ever had."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def lean(run):
    """run, a function over Arrow batches, that leaves a worker without memory to spare when its task ends."""

    def leaner(batches):
        yield from run(batches)
        trim()

    return leaner


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads every input bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def _pow(base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """base**i for i < 2**16 and base**(i * 2**16) for as many i: two small tables give any power up to 2**32, modulo 2**64."""
    have = _powers.get(int(base))
    if have is None:
        both = []
        for b in (int(base), pow(int(base), 1 << 16, 1 << 64)):
            p = np.empty(1 << 16, np.uint64)
            p[0], filled, step = 1, 1, b
            while filled < len(p):
                p[filled : 2 * filled] = p[:filled] * U64(step)
                filled, step = 2 * filled, step * step % (1 << 64)
            both.append(p)
        _powers[int(base)] = have = (both[0], both[1])
    return have


def _inverse(base: np.uint64) -> np.uint64:
    return U64(pow(int(base), -1, 1 << 64))


def prefix(values: np.ndarray, base: np.uint64) -> np.ndarray:
    """P with P[i] = sum of values[j] * base**j for j < i."""
    low, high = _pow(base)
    out = np.zeros(len(values) + 1, np.uint64)
    for k in range(0, len(values), len(low)):
        part = values[k : k + len(low)]
        np.multiply(part, low[: len(part)] * high[k >> 16], out=out[k + 1 : k + 1 + len(part)])
    return np.cumsum(out, out=out)


def span_hash(pre: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """A hash of the content of each [start, end), the same wherever it stands."""
    low, high = _pow(_inverse(base))
    return mix((pre[ends] - pre[starts]) * low[starts & 0xFFFF] * high[starts >> 16] + (ends - starts).astype(np.uint64))


class Texts:
    """Some texts as bytes: data, off (a text is data[off[i]:off[i + 1]]) and, when asked for, words."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = False):
        self.raw, self.off, self.n = data, off, len(off) - 1
        self.data = LOWER[data] if lower else data
        self._words = self._prefix = None

    @property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, first): bytes of each word; text i has the words first[i]:first[i + 1]."""
        if self._words is None:
            solid = NONSPACE[self.data]
            size = len(solid)
            before, after = np.zeros(size, bool), np.zeros(size, bool)
            before[1:], after[:-1] = solid[:-1], solid[1:]
            edges = self.off[(self.off > 0) & (self.off < size)]
            before[edges] = False
            after[edges - 1] = False
            starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
            self._words = starts, ends, np.searchsorted(starts, self.off)
        return self._words

    def byte_prefix(self) -> np.ndarray:
        if self._prefix is None:
            self._prefix = prefix(_BYTE[self.data], _BASE)
        return self._prefix

    def word_hashes(self) -> np.ndarray:
        s, e, _ = self.words
        return span_hash(self.byte_prefix(), s, e, _BASE)

    def chars_before(self) -> np.ndarray:
        """Code points before each byte position."""
        out = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=out[1:])
        return out


def window_hashes(words: np.ndarray, first: np.ndarray, n: int, base: np.uint64 = _STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of n words that lie in one text: (position of the first word, text, hash)."""
    room = np.maximum(np.diff(first) - n + 1, 0)
    text = np.repeat(np.arange(len(room)), room)
    skipped = np.concatenate([[0], np.cumsum(room)])[:-1]
    at = np.arange(len(text)) + np.repeat(first[:-1] - skipped, room)
    return at, text, span_hash(prefix(words, base), at, at + n, base)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which entries occur twice or more."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out


def covered(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of size words lie in a window of n words starting at one of at."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + n, size), -1)
    return np.cumsum(edge[:-1]) > 0


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over first[i]:first[i + 1]."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def texts_of(column: pa.Array, lower: bool = False, chunk: int = CHUNK) -> Iterator[tuple[int, int, Texts]]:
    """(lo, hi, Texts) for runs of rows of about chunk bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    off = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + chunk, "right")) - 1)
        yield lo, hi, Texts(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], lower)
        lo = hi
    trim()
