"""Vectorised words and shingles over Arrow string columns.

A word is a maximal run of bytes other than space and 0x09-0x0D in the UTF-8
text with A-Z lower-cased (no other letter changes). All hashes are 64 bits.
Work proceeds in chunks of whole texts of about ``CHUNK`` bytes, so memory is
bounded by the chunk or the longest text.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
K = 5

# Large arrays go back to the system when they are freed, not to the worker's heap, and so do Arrow's.
with contextlib.suppress(OSError, AttributeError):
    ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
pa.set_memory_pool(pa.system_memory_pool())

_U = np.uint64
_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))
_SHINGLE = mix(np.arange(11, 11 + 64, dtype=np.uint64) * _U(0xA0761D6478BD642F)) | _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LETTER_HASH = _BYTE[_LOWER]
#: For words without punctuation: every ASCII character but letters and digits separates.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[128:] = False
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i <= n."""
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK + 1)
        for k, p in enumerate((_P, _PINV)):
            x = np.full(size, p, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (len + 1) and bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    _, at, data = column.buffers()
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


def parts(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows, so that less is held at once.

    A worker that tokenized before drops its encoders first.
    """
    if (tokens := sys.modules.get("labelgraph.llm.tokens")) and tokens._encoders:
        tokens._encoders.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)
    for batch in batches:
        for lo in range(0, len(batch), rows):
            yield batch.slice(lo, rows)
    if len(_powers[0]) > CHUNK + 1:  # grown for a long text
        _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def chunks(off: np.ndarray, size: int = CHUNK, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``rows`` whole texts of at most ``size`` bytes, or one longer text."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        hi = min(hi, n, lo + rows)
        yield lo, hi
        lo = hi


def whole_shingle(h: np.ndarray) -> np.ndarray:
    """The one shingle of a text of fewer words than a shingle has, from its word hashes."""
    return mix(np.array([(h * _SHINGLE[: len(h)]).sum(dtype=np.uint64) + _U(len(h))], np.uint64))[0]


class Words:
    """Words of consecutive texts: ``start``/``end`` byte offsets, ``hash`` and
    ``first`` (index of each text's first word; len(texts) + 1 entries)."""

    def __init__(self, off: np.ndarray, raw: np.ndarray, space: np.ndarray = _SPACE, letters: np.ndarray = _LETTER_HASH):
        off = off - off[0]
        n = len(raw)
        solid = ~space[raw]
        inner = off[1:-1]
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = solid[:-1]
            before[inner[inner < n]] = False
            after = np.empty(n, bool)
            after[-1] = False
            after[:-1] = solid[1:]
            after[inner[(inner > 0)] - 1] = False
            self.start = np.flatnonzero(solid & ~before)
            self.end = np.flatnonzero(solid & ~after) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, off)
        p, inv = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(letters[raw] * p[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * inv[self.start] + (self.end - self.start).astype(np.uint64))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def shingles(self, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word windows in order, and each text's first index.

        A text of 1..k-1 words has one shingle, its whole sequence.
        """
        n = self.counts()
        per = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
        first = np.zeros(len(n) + 1, np.int64)
        np.cumsum(per, out=first[1:])
        out = np.empty(first[-1], np.uint64)
        h = self.hash
        if len(h) >= k:
            roll = h[: len(h) - k + 1] * _SHINGLE[0]
            for j in range(1, k):
                roll += h[j : len(h) - k + 1 + j] * _SHINGLE[j]
            long = n >= k
            at = np.repeat(self.first[:-1][long] - first[:-1][long], per[long])
            slot = np.repeat(long, per)
            out[slot] = roll[np.flatnonzero(slot) + at]
        for d in np.flatnonzero((n > 0) & (n < k)):
            s = h[self.first[d] : self.first[d + 1]]
            out[first[d]] = (s * _SHINGLE[: len(s)]).sum(dtype=np.uint64) + _U(len(s))
        return mix(out), first


def shingle_sets(column: pa.Array, k: int = K) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text."""
    off, raw = text_buffers(column)
    for lo, hi in chunks(off):
        w = Words(off[lo : hi + 1], raw[off[lo] : off[hi]])
        s, first = w.shingles(k)
        for d in range(hi - lo):
            yield lo + d, np.unique(s[first[d] : first[d + 1]])
