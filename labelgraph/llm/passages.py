"""Removal of repeated passages: a compressed FM-index per shard, searched by streams of words.

A word goes when a window of ``WINDOW`` words that covers it also starts earlier (in a smaller
doc_id, or earlier in the same document). Windows stay inside documents.

1. Whole copies: all but the first document of equal word sequences vanish at once.
2. Anchors: the least hash of the ``GRAM``-word strings of a window is its anchor, so that equal
   windows have equal anchors and neighbouring windows mostly share one. Windows whose
   anchor occurs once, then those whose 64-bit fingerprint occurs once, have no
   equal elsewhere. Blocks of texts ask about their distinct values only, so a
   frequent one costs a block one value.
3. Shards: runs of windows left with one anchor form segments, which are dealt by
   anchor; those of an anchor that very many blocks hold are dealt window by
   window by fingerprint. A block sends each distinct segment once. Every shard builds an
   FM-index (wavelet matrix, packed bits) of its distinct segments; the blocks' segments
   stream through it from right to left, and backward search, with matches cut back to
   ``WINDOW`` words, leads each window to the rows of all windows equal to it. The
   first of them by document and place stays, the others are reported to their blocks.

Filters may only let too much pass; equality is decided in the shards, by words of 64-bit
hashes: two windows are confused only if they differ just in words whose hashes collide.
Memory is bounded by a block of text (``BLOCK`` bytes or one longer text) and
by a shard (about ``SHARD`` windows; their number grows with the input).

Edge cases: null text has no words; documents shorter than WINDOW lose nothing; a document
wholly removed has kept_sha256 of the empty string; rows with a null doc_id lose nothing and
count for no other row; rows of one doc_id with different words are documents ordered by
the hash of their words, those with the same words are one document and returned each; an
empty table gives an empty result; other columns are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fm_index import FMIndex
from .store import bounded_batches, written
from .words import _BYTE, _SHINGLE, Words, chunks, mix, text_buffers

WINDOW, GRAM = 20, 8
BLOCK, VALUES, SHARD = 2 << 20, 1_000_000, 300_000
#: An anchor that more blocks hold is dealt window by window.
HOT = 64
IDS_SENT = 1_000_000
_MOST = np.uint64((1 << 64) - 1)

_BLOCK = [("block", "long"), ("ids", "binary"), ("subs", "binary"), ("lengths", "binary"), ("data", "binary"), ("size", "long"), ("words", "long")]
_LEFT = [*_BLOCK, ("mask", "binary"), ("hot", "binary"), ("n", "long")]
_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}


def _ddl(columns: list[tuple[str, str]]) -> str:
    return ", ".join(f"{n} {t}" for n, t in columns)


def _batch(columns: list[tuple[str, str]], rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(cols, columns, strict=True)], names=[n for n, _ in columns])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(len(batch)):
            yield batch.slice(i, 1).to_pylist()[0]


def _sub(sha: bytes) -> int:
    return int.from_bytes(sha[:8], "big", signed=True)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_words, sub, sha) of every row: the hash of its words, and the hash's first bytes as a number."""
    columns = [("doc_id", "long"), ("n_words", "long"), ("sub", "long"), ("sha", "string")]
    for batch in batches:
        out = []
        for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = (text or "").encode().split()
            sha = hashlib.sha256(b" ".join(words)).digest()
            out.append((d, len(words), _sub(sha), sha.hex()))
        yield _batch(columns, out)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of texts in order of (doc_id, sub)."""
    block, docs, room = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = (text or "").encode()
            docs.append((d, _sub(hashlib.sha256(b" ".join(raw.split())).digest()), raw))
            room += len(docs[-1][2])
            if room >= BLOCK:
                yield _batch(_BLOCK, [_block(block, docs)])
                block, docs, room = block + 1, [], 0
    if docs:
        yield _batch(_BLOCK, [_block(block, docs)])


def _block(block: int, docs: list[tuple]) -> tuple:
    docs = [(*k, t) for k, t in sorted({(d, s): t for d, s, t in docs}.items())]  # one of equal rows
    raw = b"".join(t for _, _, t in docs)
    ids, subs, lengths = (np.array(x, "<i8").tobytes() for x in ([d for d, _, _ in docs], [s for _, s, _ in docs], [len(t) for _, _, t in docs]))
    return block, ids, subs, lengths, pa.compress(raw, "zstd", asbytes=True) if raw else b"", len(raw), sum(len(t.split()) for _, _, t in docs)


class Texts:
    """An opened block: hashes ``h`` of all its words, and ``first``, the index of each text's first word."""

    def __init__(self, row: dict):
        self.ids, self.subs, lengths = (np.frombuffer(row[c], "<i8") for c in ("ids", "subs", "lengths"))
        self.off = np.r_[0, np.cumsum(lengths)]
        self.raw = np.frombuffer(pa.decompress(row["data"], row["size"], "zstd", asbytes=True), np.uint8) if row["size"] else np.zeros(0, np.uint8)
        hashes, first, n = [], [np.zeros(1, np.int64)], 0
        for lo, hi in chunks(self.off):
            w = Words(self.off[lo : hi + 1], self.raw[self.off[lo] : self.off[hi]], letters=_BYTE)
            hashes.append(w.hash)
            first.append(w.first[1:] + n)
            n += len(w.hash)
        self.h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.first = np.concatenate(first)

    def begins(self, size: int) -> np.ndarray:
        """Places of the words that ``size`` words of one text start with."""
        return np.arange(len(self.h)) + size <= np.repeat(self.first[1:], np.diff(self.first))

    def hashes(self, size: int) -> np.ndarray:
        """Hashes of the ``size`` words from each place on; the greatest number where there are not so many."""
        n = len(self.h) - size + 1
        out = np.full(len(self.h), _MOST)
        if n > 0:
            roll = np.zeros(n, np.uint64)
            for j in range(size):
                roll += self.h[j : n + j] * _SHINGLE[j]
            out[:n] = np.minimum(mix(roll), _MOST - np.uint64(1))
            out[~self.begins(size)] = _MOST
        return out

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(windows' anchors, places of the strings that are some window's anchor)."""
        grams, reach = self.hashes(GRAM), WINDOW - GRAM + 1
        least = _sliding(grams, reach, np.minimum, _MOST)
        least[~self.begins(WINDOW)] = 0
        most = _sliding(least[::-1], reach, np.maximum, np.uint64(0))[::-1]
        return least, np.flatnonzero((most == grams) & (grams != _MOST))


def _sliding(x: np.ndarray, size: int, op: Callable, beyond: np.uint64) -> np.ndarray:
    """op over x[i : i + size], by doubling."""
    done, out = 1, x.copy()
    shifted = lambda a, k: np.r_[a[k:], np.full(min(k, len(a)), beyond)]
    while done < size:
        step = min(done, size - done)
        out = op(out, shifted(out, step))
        done += step
    return out


def _bits(n: float, room: int) -> int:
    return max(6, int(np.ceil(np.log2(max(1.0, n / room)))))


def shared(blocks: DataFrame, values: Callable[[dict], np.ndarray], n: float, hot: int = HOT) -> DataFrame:
    """(block, found): for each distinct value of a block, in order, whether it occurs twice anywhere (1) and in very many blocks (2).

    ``n`` is about how many values there are. Buckets compare 32 bits beyond their number.
    """
    bits = _bits(n, VALUES)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            u, count = np.unique(mix(values(row)), return_counts=True)
            own, at = np.unique((u >> np.uint64(64 - bits)).astype(np.int64), return_index=True)
            low = (u >> np.uint64(32 - bits)).astype("<u4")
            cut = [*zip(at, np.r_[at[1:], len(u)][: len(at)], strict=True)]
            yield _batch([("bucket", "int"), ("block", "long"), ("low", "binary"), ("many", "binary")], [(int(b), row["block"], low[i:j].tobytes(), (count[i:j] > 1).tobytes()) for b, (i, j) in zip(own, cut, strict=True)])

    def rank(rows: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, "<u4") for x in rows["low"].to_pylist()]
        low, many = np.concatenate(parts), np.concatenate([np.frombuffer(x, bool) for x in rows["many"].to_pylist()])
        _, inverse, count = np.unique(low, return_inverse=True, return_counts=True)
        held = count[inverse]
        code = np.where(held > hot, 2, (held > 1) | many).astype(np.uint8)
        at = np.cumsum([0, *map(len, parts)])
        return pa.table({"block": rows["block"], "bucket": rows["bucket"], "codes": pa.array([code[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())})

    told = blocks.mapInArrow(send, "bucket int, block long, low binary, many binary").groupBy("bucket").applyInArrow(rank, "block long, bucket int, codes binary")
    return told.groupBy("block").agg(F.collect_list(F.struct("bucket", "codes")).alias("found"))


def _told(values: np.ndarray, asked: np.ndarray, found: list | None) -> np.ndarray:
    """The codes of ``values``, some of the values ``asked`` about."""
    u = np.unique(mix(asked))
    codes = np.frombuffer(b"".join(f["codes"] for f in sorted(found or (), key=lambda f: f["bucket"])), np.uint8)
    return codes[np.searchsorted(u, mix(values))] if len(values) else np.zeros(0, np.uint8)


def _asked_anchors(row: dict) -> np.ndarray:
    least, places = (t := Texts(row)).anchors()
    return t.hashes(GRAM)[places]


def _after_anchors(row: dict) -> tuple[Texts, np.ndarray, np.ndarray]:
    """(texts, places of the windows whose anchor occurs twice, whether it is hot)."""
    t = Texts(row)
    least, places = t.anchors()
    window = np.flatnonzero(t.begins(WINDOW))
    code = _told(least[window], t.hashes(GRAM)[places], row["found"])
    return t, window[code > 0], code[code > 0] == 2


def _asked_windows(row: dict) -> np.ndarray:
    t, window, _ = _after_anchors(row)
    return t.hashes(WINDOW)[window]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of just the texts that hold windows left; mask and hot: one bit a word."""
    for row in _rows(batches):
        t, window, hot = _after_anchors(row)
        value = t.hashes(WINDOW)[window]
        keep = _told(value, value, row["again"]) > 0
        mask, very = np.zeros(len(t.h), bool), np.zeros(len(t.h), bool)
        mask[window[keep]], very[window[keep]] = True, hot[keep]
        docs = np.unique(np.searchsorted(t.first, window[keep], "right") - 1)
        if len(docs):
            words = np.concatenate([np.arange(t.first[d], t.first[d + 1]) for d in docs])
            raw = b"".join(t.raw[t.off[d] : t.off[d + 1]].tobytes() for d in docs)
            packed = (pa.compress(np.packbits(m[words]).tobytes(), "zstd", asbytes=True) for m in (mask, very))
            yield _batch(_LEFT, [(row["block"], t.ids[docs].tobytes(), t.subs[docs].tobytes(), np.diff(t.off)[docs].astype("<i8").tobytes(), pa.compress(raw, "zstd", asbytes=True), len(raw), len(words), *packed, int(keep.sum()))])


class Segments:
    """Runs of a block's windows with one anchor, equal ones together.

    start: first word, n: windows, value: what deals it, same: the first segment with the same words.
    """

    def __init__(self, row: dict):
        t = self.texts = Texts(row)
        unpack = lambda c: np.unpackbits(np.frombuffer(pa.decompress(row[c], (row["words"] + 7) // 8, "zstd", asbytes=True), np.uint8), count=row["words"]).astype(bool)
        mask, hot = unpack("mask"), unpack("hot")
        least, _ = t.anchors()
        window = np.flatnonzero(mask)
        joined = np.r_[False, (np.diff(window) == 1) & (least[window][1:] == least[window][:-1]) & ~hot[window][1:] & ~hot[window][:-1]]
        head = np.flatnonzero(~joined)
        self.start, self.n = window[head], np.diff(np.r_[head, len(window)])
        alone = hot[self.start]
        self.value = np.where(alone, t.hashes(WINDOW)[self.start], least[self.start])
        seen: dict[bytes, int] = {}
        self.same = np.array([seen.setdefault(self.words(i).tobytes(), i) for i in range(len(self.start))], np.int64)

    def words(self, i: int) -> np.ndarray:
        return self.texts.h[self.start[i] : self.start[i] + self.n[i] + WINDOW - 1]

    def dealt(self, bits: int) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, its distinct segments)."""
        own = np.flatnonzero(self.same == np.arange(len(self.same)))
        shard = (mix(self.value[own]) >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        ids, at = np.unique(shard[order], return_index=True)
        for s, i, j in zip(ids, at, np.r_[at[1:], len(order)][: len(at)], strict=True):
            yield int(s), own[order[i:j]]


def later_windows(left: DataFrame, bits: int) -> DataFrame:
    """(block, shard, bits): for the windows of the segments that a block sent to a shard, whether an equal one starts earlier."""
    sent = [("shard", "int"), ("block", "long"), ("vocabulary", "binary"), ("words", "binary"), ("counts", "binary"), ("docs", "binary"), ("subs", "binary"), ("starts", "binary")]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            seg = Segments(row)
            t, out = seg.texts, []
            for shard, own in seg.dealt(bits):
                doc = np.searchsorted(t.first, seg.start[own], "right") - 1
                vocabulary, words = np.unique(np.concatenate([seg.words(i) for i in own]), return_inverse=True)
                numbers = ((words, "<u4"), (seg.n[own], "<u4"), (t.ids[doc], "<i8"), (t.subs[doc], "<i8"), (seg.start[own] - t.first[doc], "<i8"))
                out.append((shard, row["block"], vocabulary.tobytes(), *(x.astype(k).tobytes() for x, k in numbers)))
            yield _batch(sent, out)

    def search(rows: pa.Table) -> pa.Table:
        read = lambda c, k: [np.frombuffer(x, k) for x in rows[c].to_pylist()]
        vocabularies, counts = read("vocabulary", "<u8"), read("counts", "<u4")
        vocabulary = np.unique(np.concatenate(vocabularies))
        segments, numbers, seen = [], [], {}
        for v, w, n in zip(vocabularies, read("words", "<u4"), counts, strict=True):
            symbol = (np.searchsorted(vocabulary, v) + 1).astype(np.int32)[w]
            for part in np.split(symbol, np.cumsum(n.astype(np.int64) + WINDOW - 1)[:-1]):
                k = seen.setdefault(part.tobytes(), len(segments))
                if k == len(segments):
                    segments.append(part)
                numbers.append(k)
        index = FMIndex(np.concatenate([np.r_[np.int32(0), s] for s in segments]), WINDOW)
        classes = index.classes(segments)
        size = np.array([len(c) for c in classes])
        first = np.cumsum(size) - size
        classes = np.concatenate(classes)

        doc, sub, start = (np.concatenate(read(c, "<i8")) for c in ("docs", "subs", "starts"))
        order = np.lexsort((sub, doc))
        rank = np.zeros(len(doc), np.int64)
        rank[order] = np.cumsum(np.r_[False, (np.diff(doc[order]) != 0) | (np.diff(sub[order]) != 0)])
        numbers = np.array(numbers)
        n = size[numbers]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        mine = classes[np.repeat(first[numbers], n) + place]
        key = np.repeat(rank << 40 | start, n) + place
        order = np.argsort(mine, kind="stable")
        heads = np.flatnonzero(np.r_[True, np.diff(mine[order]) != 0])
        earliest = np.zeros(len(index.class_start), np.int64)
        earliest[mine[order][heads]] = np.minimum.reduceat(key[order], heads)
        later = key > earliest[mine]
        at = np.cumsum([0, *(int(c.sum()) for c in counts)])
        return pa.table({"block": rows["block"], "shard": rows["shard"], "bits": pa.array([np.packbits(later[a:b]).tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())})

    told = left.mapInArrow(send, _ddl(sent)).groupBy("shard").applyInArrow(search, "block long, shard int, bits binary")
    return told.groupBy("block").agg(F.collect_list(F.struct("shard", "bits")).alias("told"))


def cut_texts(left: DataFrame, later: DataFrame, bits: int) -> DataFrame:
    """(doc_id, sub, n_removed, kept_sha256, spans): spans are the removed runs of words as start, end in turn."""
    columns = [("doc_id", "long"), ("sub", "long"), ("n_removed", "long"), ("kept_sha256", "string"), ("spans", "array<long>")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            seg = Segments(row)
            t, told = seg.texts, {x["shard"]: x["bits"] for x in row["told"] or ()}
            step = np.zeros(len(t.h) + 1, np.int32)
            again = np.flatnonzero(seg.same != np.arange(len(seg.same)))
            step[seg.start[again]] += 1
            np.subtract.at(step, seg.start[again] + seg.n[again] + WINDOW - 1, 1)
            for shard, own in seg.dealt(bits):
                n = seg.n[own]
                later = np.unpackbits(np.frombuffer(told[shard], np.uint8), count=n.sum()).astype(bool)
                place = (np.repeat(seg.start[own] - np.cumsum(n) + n, n) + np.arange(n.sum()))[later]
                np.add.at(step, place, 1)
                np.subtract.at(step, place + WINDOW, 1)
            gone = np.cumsum(step[:-1]) > 0
            out = []
            for d, (a, b) in enumerate(zip(t.first, t.first[1:], strict=False)):
                g = gone[a:b]
                if g.any():
                    words = np.array(t.raw[t.off[d] : t.off[d + 1]].tobytes().split(), object)
                    edge = np.flatnonzero(np.diff(np.r_[False, g, False]))
                    out.append((int(t.ids[d]), int(t.subs[d]), int(g.sum()), hashlib.sha256(b" ".join(words[~g])).hexdigest(), edge.tolist()))
            yield _batch(columns, out)

    return left.join(later, "block", "left").mapInArrow(cut, _ddl(columns))


def remove_passages(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans) for every row of ``docs`` (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    facts = written(texts.mapInArrow(_facts, "doc_id long, n_words long, sub long, sha string"), "word-facts")
    first = written(facts.where(F.col("n_words") >= WINDOW).groupBy("sha").agg(F.min("doc_id").alias("first")), "word-firsts")
    ids = first.select(F.col("first").alias("doc_id")).where("doc_id is not null").distinct()
    few = ids.limit(IDS_SENT + 1).count() <= IDS_SENT
    chosen = texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    blocks = written(chosen.mapInArrow(_blocks, _ddl(_BLOCK)), "word-blocks")

    n = blocks.agg(F.sum("words")).first()[0] or 0
    found = written(shared(blocks, _asked_anchors, n / 6, hot), "anchors")
    blocks = blocks.join(found, "block", "left")
    again = written(shared(blocks, _asked_windows, n), "windows").withColumnRenamed("found", "again")
    left = written(blocks.join(again, "block", "left").mapInArrow(_candidates, _ddl(_LEFT)), "word-candidates")
    bits = _bits(left.agg(F.sum("n")).first()[0] or 0, SHARD)
    cuts = written(cut_texts(left, written(later_windows(left, bits), "later-windows"), bits), "word-cuts").dropDuplicates(["doc_id", "sub"])

    copy = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    zero = F.lit(0).cast("long")
    return (
        facts.join(first, "sha", "left")
        .join(cuts, ["doc_id", "sub"], "left")
        .select(
            "doc_id",
            "n_words",
            F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
            F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
            F.when(copy, F.array(zero, F.col("n_words"))).otherwise(F.coalesce("spans", F.array().cast("array<bigint>"))).alias("spans"),
        )
    )
