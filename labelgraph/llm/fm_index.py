"""A compressed full-text index over integers: Burrows-Wheeler transform in a wavelet matrix.

``FMIndex`` sorts the suffixes of a text by their first ``2 * DEPTH_POWER`` symbols, which is
enough for backward search of patterns up to that length. All searches work on
many patterns at once. Bits are packed, 64 to a word, with one count a word.
"""

from __future__ import annotations

import numpy as np

ROUNDS = 5  # suffixes are ordered by 2 ** ROUNDS symbols
_ONE = np.uint64(1)


class Bits:
    """A bit string with rank: how many of the first i bits are set."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(np.r_[bits, np.zeros(-n % 64 + 64, bool)], bitorder="little").view("<u8")
        self.word = packed
        self.before = np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]].astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        low = (_ONE << (i & 63).astype(np.uint64)) - _ONE
        return self.before[w] + np.bitwise_count(self.word[w] & low)


class FMIndex:
    """Index of ``text``: symbols from 0, where 0 separates; patterns hold no 0."""

    def __init__(self, text: np.ndarray, threshold: int):
        if not 0 < threshold < 1 << ROUNDS:
            raise ValueError(f"threshold must be between 1 and {(1 << ROUNDS) - 1}")
        n = len(text)
        ranks = [text.astype(np.int64)]
        for k in range(ROUNDS):
            r = ranks[-1]
            ranks.append(np.unique(r * (int(r.max()) + 1) + np.roll(r, -(1 << k)), return_inverse=True)[1])
        order = np.argsort(ranks[-1], kind="stable")
        # Rows whose suffixes agree in ``threshold`` symbols form one class; classes are contiguous.
        new, at = np.zeros(n, bool), 0
        new[0] = True
        for k in range(ROUNDS):
            if threshold >> k & 1:
                r = np.roll(ranks[k], -at)[order]
                new[1:] |= r[1:] != r[:-1]
                at += 1 << k
        self.class_start = np.maximum.accumulate(np.where(new, np.arange(n), 0)).astype(np.int32)
        self.threshold = threshold

        last = np.roll(text, 1)[order].astype(np.int64)
        size = int(text.max()) + 1
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=size))][:size]
        self.levels, self.zeros, self.at = [], [], range(max(1, (size - 1).bit_length()) - 1, -1, -1)
        for level in self.at:
            bit = (last >> level & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(int(n - bit.sum()))
            last = np.r_[last[~bit], last[bit]]
        self.origin = self._down(np.arange(size), np.zeros(size, np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits, zeros in zip(self.at, self.levels, self.zeros, strict=True):
            one = bits.rank(i)
            i = np.where(symbol >> level & 1, zeros + one, i - one)
        return i

    def extend(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """First rows of ``symbol`` before patterns, from the first rows of the patterns: one step of backward search."""
        return self.before[symbol] + self._down(symbol, row) - self.origin[symbol]

    def classes(self, streams: list[np.ndarray]) -> list[np.ndarray]:
        """For each stream that the index holds, the class of every place with ``threshold`` symbols to go.

        The streams run side by side from right to left. A match that would grow beyond the
        threshold is cut back to it, which leads to the first row of its class.
        """
        t = self.threshold
        length = np.array([len(s) for s in streams])
        lanes = np.argsort(-length, kind="stable")
        length = length[lanes]
        flat = np.concatenate([streams[i] for i in lanes]) if len(lanes) else np.zeros(0, np.int64)
        end = np.cumsum(length)
        out = np.zeros(len(flat), np.int64)
        row = np.zeros(len(lanes), np.int64)
        for step in range(1, int(length[0]) + 1 if len(lanes) else 0):
            alive = int(np.searchsorted(-length, -step, "right"))
            place = end[:alive] - step
            row[:alive] = self.extend(flat[place], row[:alive]) if step > 1 else self.before[flat[place]]
            if step >= t:
                row[:alive] = self.class_start[row[:alive]]
                out[place] = row[:alive]
        found = [None] * len(streams)
        for lane, i in enumerate(lanes):
            found[i] = out[end[lane] - length[lane] : end[lane] - t + 1]
        return found
