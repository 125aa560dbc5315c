"""Benchmark decontamination by SimHash of item-sized windows.

Words are runs of letters and digits of the lower-cased text (ASCII punctuation
separates), so that case, spacing and punctuation do not hide a passage.
Every benchmark item of L words has a 64-bit SimHash of its two-word features,
and so has every window of L words of every text, for every L that occurs. The
64 bit counts of a window are differences of running sums, kept eight (for items
beyond 256 words four or two) to a 64-bit number. Fingerprints meet by multi-index
hashing: with 4 blocks of 16 bits, two within ``radius`` bits agree in some
block to within radius // 4 bits, so a lookup of all such block values finds all
of them. Each candidate is then verified exactly: the bags of 5-word shingles
of the item and of the L words at the window (shifted by up to ``SHIFT``) must
have sum(min) / sum(max) >= similarity.

Benchmark items are taken in slices of ``ITEMS`` items, one after the other, and
a slice's index takes about 4 KB an item whatever the items' lengths; with more
than one slice, what a slice finds is written before the next one's index is
made. Texts are never shuffled, but read once for each slice.

Edge cases: null or empty texts and items match nothing; an item of fewer than
5 words is one shingle and must occur whole; texts shorter than an item
are one window; repeated items and texts are reported each; among equal windows
the first is reported; a null doc_id or item_id is kept as null; empty tables
give an empty result; other columns are ignored; a long text is worked on whole,
in arrays of some 100 bytes a word of it.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches, written
from .words import K, PUNCTUATION, Words, chunks, mix, parts, text_buffers, whole_shingle

RADIUS = 11
SHIFT = 4
#: A size of up to so many items has its candidates compared with all of them.
FEW = 32
ITEMS = 20_000
_B, _BITS = 4, 16
_PAIR = np.uint64(0x9FB21C651E98DF25)


def normal_words(column: pa.Array, size: int = 1 << 19) -> Iterator[tuple[int, Words]]:
    """(first row, words) of chunks of a string column."""
    off, raw = text_buffers(pc.utf8_lower(column))
    for lo, hi in chunks(off, size):
        yield lo, Words(off[lo : hi + 1], raw[off[lo] : off[hi]], PUNCTUATION)


def _features(h: np.ndarray) -> np.ndarray:
    """Hash of each word with the next one."""
    return mix(h[:-1] * _PAIR + h[1:]) if len(h) > 1 else np.zeros(0, np.uint64)


def _near(radius: int) -> np.ndarray:
    """All 16-bit masks of at most ``radius`` bits."""
    x = np.arange(1 << _BITS, dtype=np.uint32)
    return x[np.bitwise_count(x) <= radius]


class Index:
    """Items by size; each size has its fingerprints and, for each block, the values near them in order with their items."""

    def __init__(self, items: list[tuple[int, str]], radius: int, k: int, few: int = FEW):
        self.few = few
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray, list]] = {}
        self.items = []
        by: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            _, w = next(normal_words(pa.array([text or ""])))
            n = len(w.hash)
            if not n:
                continue
            print_ = int(_simhash(_sums(w.hash, _width(n)), np.zeros(1, np.int64), n - 1)[0]) if n > 1 else int(mix(w.hash[:1])[0])
            by[n].append((len(self.items), print_))
            self.items.append((item_id, n, Counter(w.shingles(k)[0].tolist())))
        masks = _near(radius // _B)
        for size, rows in by.items():
            which = np.array([i for i, _ in rows], np.int32)
            prints = np.array([p for _, p in rows], np.uint64)
            lists = []
            for block in prints.view(np.uint16).reshape(-1, _B).T:
                value = (block[:, None] ^ masks[None, :].astype(np.uint16)).ravel()
                order = np.argsort(value, kind="stable")
                lists.append((value[order], (order // len(masks)).astype(np.int32)))
            self.sizes[size] = (which, prints, lists)


def _sums(h: np.ndarray, width: int) -> np.ndarray:
    """Running sums of the feature bits of word hashes ``h`` in lanes of ``width`` bits, (width, words).

    Row r has bits r, r + width, r + 2 * width ... of the features, one a lane. Differences of
    two sums are taken modulo 2**64 and have the lanes' counts, whatever the sums carried.
    """
    f = _features(h)
    lanes = np.uint64(sum(1 << (width * i) for i in range(64 // width)))
    out = np.zeros((width, len(f) + 1), np.uint64)
    for r in range(width):
        np.cumsum((f >> np.uint64(r)) & lanes, out=out[r, 1:])
    return out


def _width(size: int) -> int:
    return 8 if size <= 256 else 16 if size <= 65536 else 32


def _simhash(sums: np.ndarray, at: np.ndarray | slice, n: int, room: np.ndarray | None = None) -> np.ndarray:
    """Fingerprints of the windows of ``n`` features from each of ``at`` on: bits set in over half of them.

    ``at`` may be a slice of consecutive places; then ``room`` may have an array to work in.
    """
    width = len(sums)
    top = np.uint64(sum(1 << (width * i + width - 1) for i in range(64 // width)))
    more = np.uint64(sum(((1 << (width - 1)) - n // 2 - 1) << (width * i) for i in range(64 // width)))
    if room is None:
        x = sums[:, slice(at.start + n, at.stop + n) if isinstance(at, slice) else at + n] - sums[:, at]
    else:
        x = room[: width * (at.stop - at.start)].reshape(width, -1)
        np.subtract(sums[:, at.start + n : at.stop + n], sums[:, at], out=x)
    np.add(x, more, out=x)
    np.bitwise_and(x, top, out=x)
    np.right_shift(x, np.arange(width - 1, -1, -1, dtype=np.uint64)[:, None], out=x)  # counts' top bits back to their places in the features
    return np.bitwise_or.reduce(x, axis=0)


_SPAN = 16384  # windows worked on at once, so that they stay in the processor's cache


def _match(w: Words, index: Index, radius: int, k: int, similarity: float) -> Iterator[tuple[int, int, int, float]]:
    """(text, item, start word, similarity) of verified windows."""
    h, first = w.hash, w.first
    n_words = np.diff(first)
    if not len(h) or not index.sizes:
        return
    sums = {width: _sums(h, width) for width in {_width(size) for size in index.sizes if size > 1}}
    doc = np.repeat(np.arange(len(n_words)), n_words)
    last = first[1:][doc]  # end of each word's text
    room = last - np.arange(len(h))
    hits: dict[tuple[int, int], set[int]] = defaultdict(set)
    near = [np.zeros(1 << _BITS, bool) for _ in range(_B)]

    def add(places: np.ndarray, items: np.ndarray) -> None:
        for a, x in zip(places.tolist(), items.tolist(), strict=True):
            hits[int(doc[a]), x].add(a)

    def look(fp: np.ndarray, at: np.ndarray | int, size: int, which: np.ndarray, prints: np.ndarray, lists: list) -> None:
        blocks = fp.view(np.uint16).reshape(-1, _B).T.astype(np.intp, order="C")
        some = near[0].take(blocks[0], mode="clip")
        for b in range(1, _B):
            some |= near[b].take(blocks[b], mode="clip")
        some = np.flatnonzero(some)
        if isinstance(at, int):
            some = some[room[some + at] >= size]  # windows inside one text
        if not len(some):
            return
        fp = fp[some]
        if len(prints) <= index.few:  # found by a block; compare with all items of the size
            rep, i = np.nonzero(np.bitwise_count(fp[:, None] ^ prints[None, :]) <= radius)
            add(some[rep] + at if isinstance(at, int) else at[some[rep]], which[i])
            return
        blocks = blocks[:, some]
        for b, (value, item) in enumerate(lists):
            mine = np.flatnonzero(near[b].take(blocks[b]))
            if not len(mine):
                continue
            key = blocks[b, mine].astype(np.uint16)
            lo = np.searchsorted(value, key, "left")
            many = np.searchsorted(value, key, "right") - lo
            rep = np.repeat(mine, many)
            i = item[np.repeat(lo, many) + np.arange(len(rep)) - np.repeat(np.cumsum(many) - many, many)]
            ok = np.flatnonzero(np.bitwise_count(fp[rep] ^ prints[i]) <= radius)
            add(some[rep[ok]] + at if isinstance(at, int) else at[some[rep[ok]]], which[i[ok]])

    span = -(-len(h) // -(-len(h) // _SPAN))
    rooms = {width: np.empty(width * span, np.uint64) for width in sums}
    for lo in range(0, len(h), span):  # a span's sums serve all sizes while they are in the cache
        for size, (which, prints, lists) in index.sizes.items():
            hi = min(lo + span, len(h) - size + 1)
            if size == 1 or lo >= hi:
                continue
            for b, (value, _) in enumerate(lists):
                near[b][value] = True
            look(_simhash(sums[_width(size)], slice(lo, hi), size - 1, rooms[_width(size)]), lo, size, which, prints, lists)
            for b, (value, _) in enumerate(lists):
                near[b][value] = False
    for size, (which, prints, lists) in index.sizes.items():
        if size == 1:
            for i, p in zip(which.tolist(), prints, strict=True):
                for at in np.flatnonzero(mix(h) == p).tolist():
                    hits[int(doc[at]), i].add(at)
            continue
        short = np.flatnonzero((n_words > 1) & (n_words < size))  # whole texts shorter than the item
        if len(short):
            for b, (value, _) in enumerate(lists):
                near[b][value] = True
            for n in np.unique(n_words[short]).tolist():
                at = first[:-1][short[n_words[short] == n]]
                look(_simhash(sums[_width(size)], at, n - 1), at, size, which, prints, lists)
            for b, (value, _) in enumerate(lists):
                near[b][value] = False
    if not hits:
        return
    s, s_first = w.shingles(k)
    for (d, i), places in sorted(hits.items()):
        _, size, bag = index.items[i]
        lo, hi = int(first[d]), int(first[d + 1])
        best = (0.0, 0)
        if size < k:
            # Short items are one shingle, the words in order; compare the words of each place.
            for a in sorted(places):
                if a + size <= hi and int(whole_shingle(h[a : a + size])) in bag:
                    best = max(best, (1.0, lo - a))
        else:
            tried = {max(lo, min(a + j, hi - size)) for a in places for j in range(-SHIFT, SHIFT + 1)}
            for a in sorted(tried):
                if hi - lo < k:
                    break
                x = s_first[d] + a - lo
                got = Counter(s[x : x + min(size, hi - a) - k + 1].tolist())
                common = sum((got & bag).values())
                best = max(best, (common / (got.total() + bag.total() - common), lo - a))
        if best[0] >= similarity:
            yield d, i, -best[1], best[0]


def contamination(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = RADIUS, k: int = K, items_a_slice: int = ITEMS, few: int = FEW) -> DataFrame:
    """(doc_id, item_id, start_word, n_item_words, similarity): the best window of each text for each item it holds."""
    spark = docs.sparkSession
    bounded_batches(spark)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Slices by a hash of the item: each has about items_a_slice items whatever the benchmark's size.
    slices = max(1, -(-benchmark.count() // items_a_slice))
    out = []
    for part in range(slices):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == part).select("item_id", "text").collect()
        index = spark.sparkContext.broadcast(Index(sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")), radius, k, few))

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in parts(batches):
                found = []
                for lo, w in normal_words(batch.column(1)):
                    found += [(lo + d, *index.value.items[i][:2], a, x) for d, i, a, x in _match(w, index.value, radius, k, similarity)]
                cols = list(zip(*found, strict=True)) if found else [[]] * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[4], pa.float64())], names=["doc_id", "item_id", "start_word", "n_item_words", "similarity"])

        found = ids.mapInArrow(scan, "doc_id long, item_id long, start_word long, n_item_words long, similarity double")
        if slices > 1:
            found = written(found, "contaminated")
            index.destroy()
        out.append(found)
    return reduce(DataFrame.unionByName, out)
