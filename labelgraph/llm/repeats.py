"""Exact removal of repeated byte strings, by a difference cover and blockwise suffix buckets.

A byte goes when a ``LENGTH``-byte string that covers it also starts earlier (in a
smaller doc_id, or earlier in the same document). Matches stay inside documents.

1. Whole copies: all but the first document of equal texts vanish at once.
2. Cover sample: suffixes at places p with p mod V in a difference cover D are
   ranked by their first LENGTH - V + 1 bytes into classes of equal strings. For
   any two places some shift below V puts both into the sample, so a suffix
   whose next V places hold no sample of a class shared with another one has
   no equal elsewhere and needs no sorting.
3. Blockwise: the suffixes left are dealt to buckets by a fingerprint of their
   first LENGTH bytes, and one bucket at a time is sorted by (fingerprint,
   document, place). Ties longer than LENGTH need no further bytes. All but the
   first of equal ones are repeats; their bytes are removed.

Only equality of LENGTH-byte prefixes matters here, so classes and buckets are
ordered by 64-bit fingerprints instead of the bytes themselves. Memory is
bounded by a block of text (``BLOCK`` bytes or one longer text) and by a bucket
(about ``BUCKET`` suffixes, their number growing with the input). Buckets get
only fingerprints; what they find returns as one bit a suffix, in order.

Edge cases: null text is empty; texts shorter than LENGTH lose nothing; a text
wholly removed has kept_sha256 of the empty string; rows that repeat a doc_id
with the same text count as one document and are returned each; rows with a null
doc_id lose nothing and count for no other row; different texts under one
doc_id have no defined order; an empty table gives an empty result; other columns
are not used; a long text is one block, whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import released, written
from .words import _BYTE, mix, powers, text_buffers

LENGTH = 100
# A perfect difference set, every residue mod 57 is a difference of two of its members.
V, COVER = 57, (0, 1, 3, 13, 32, 36, 43, 52)
BLOCK, BUCKET = 2 << 20, 1_000_000
IDS_SENT = 1_000_000
_IN_COVER = np.isin(np.arange(V), COVER)


def fingerprints(raw: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """64-bit fingerprints of raw[p : p + size] for p in ``at``, in pieces of bounded size."""
    out = np.empty(len(at), np.uint64)
    step = 1 << 19
    for lo in range(0, len(raw), step):
        a, b = np.searchsorted(at, (lo, lo + step))
        if a < b:
            part = raw[lo : lo + step + size]
            p, inv = powers(len(part) + 1)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTE[part] * p[: len(part)], out=total[1:])
            x = at[a:b] - lo
            out[a:b] = (total[x + size] - total[x]) * inv[x]
    return mix(out)


def _places(off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the text of every byte."""
    n = np.diff(off)
    return np.repeat(off[:-1], n), np.repeat(off[1:], n)


def _samples(off: np.ndarray, raw: np.ndarray, length: int) -> np.ndarray:
    start, end = _places(off)
    at = np.arange(len(raw))
    return at[_IN_COVER[(at - start) % V] & (at + length - V + 1 <= end)]


def _dealt(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order by bucket, and the buckets' bounds in it."""
    bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")
    return order, np.r_[0, np.cumsum(np.bincount(bucket, minlength=1 << bits))]


def _returned(h: np.ndarray, bits: int, found: list[dict]) -> np.ndarray:
    """The buckets' bits, back in the order of ``h``."""
    order, cut = _dealt(h, bits)
    flags = np.zeros(len(h), bool)
    for f in found or ():
        a, b = cut[f["bucket"]], cut[f["bucket"] + 1]
        flags[order[a:b]] = np.unpackbits(np.frombuffer(f["bits"], np.uint8), count=b - a).astype(bool)
    return flags


def _bits(n: float) -> int:
    return max(6, int(np.ceil(np.log2(max(1.0, n / BUCKET)))))


_BLOCKS = "block long, doc_ids binary, lengths binary, data binary, size long"


def _block(block: int, ids: list, lengths: list, raw: bytes) -> dict:
    return {"block": block, "doc_ids": np.array(ids, "<i8").tobytes(), "lengths": np.array(lengths, "<i8").tobytes(), "data": pa.compress(raw, "zstd", asbytes=True) if raw else b"", "size": len(raw)}


def _open(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.frombuffer(row["lengths"], "<i8")
    raw = np.frombuffer(pa.decompress(row["data"], row["size"], "zstd", asbytes=True), np.uint8) if row["size"] else np.zeros(0, np.uint8)
    return np.frombuffer(row["doc_ids"], "<i8"), np.r_[0, np.cumsum(lengths)], raw


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(len(batch)):
            yield batch.slice(i, 1).to_pylist()[0]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.binary()), ("lengths", pa.binary()), ("data", pa.binary()), ("size", pa.int64())])
    block, ids, lengths, parts, room = TaskContext.get().partitionId() << 32, [], [], [], 0
    for batch in batches:
        off, raw = text_buffers(batch.column(1))
        for i, d in enumerate(batch.column(0).to_pylist()):
            ids.append(d)
            lengths.append(int(off[i + 1] - off[i]))
            parts.append(raw[off[i] : off[i + 1]].tobytes())
            room += lengths[-1]
            if room >= BLOCK:
                yield pa.RecordBatch.from_pylist([_block(block, ids, lengths, b"".join(parts))], schema)
                block, ids, lengths, parts, room = block + 1, [], [], [], 0
    if ids:
        yield pa.RecordBatch.from_pylist([_block(block, ids, lengths, b"".join(parts))], schema)


def _back(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks with what the buckets found in them."""
    by = found.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("found"))
    return blocks.join(by, "block", "left")


def shared_samples(blocks: DataFrame, bits: int, length: int) -> DataFrame:
    """(block, bucket, bits): which samples' strings occur at another sample too."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            _, off, raw = _open(row)
            h = fingerprints(raw, _samples(off, raw, length), length - V + 1)
            order, cut = _dealt(h, bits)
            low = (h >> np.uint64(32 - bits)).astype("<u4")[order]
            own = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array([row["block"]] * len(own), pa.int64()), pa.array([low[cut[b] : cut[b + 1]].tobytes() for b in own], pa.binary())], names=["bucket", "block", "low"])

    def rank(rows: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, "<u4") for x in rows["low"].to_pylist()]
        low = np.concatenate(parts)
        order = np.argsort(low, kind="stable")
        same = low[order][1:] == low[order][:-1]
        shared = np.zeros(len(low), bool)
        shared[order] = np.r_[False, same] | np.r_[same, False]
        at = np.cumsum([0, *map(len, parts)])
        return pa.table({"block": rows["block"], "bucket": rows["bucket"], "bits": pa.array([np.packbits(shared[a:b]).tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())})

    sent = blocks.mapInArrow(send, "bucket int, block long, low binary")
    return sent.groupBy("bucket").applyInArrow(rank, "block long, bucket int, bits binary")


def candidates(blocks: DataFrame, shared: DataFrame, bits: int, length: int) -> DataFrame:
    """Blocks of just the texts that hold suffixes to sort; mask: those suffixes' places, one bit a byte."""
    schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.binary()), ("lengths", pa.binary()), ("data", pa.binary()), ("size", pa.int64()), ("mask", pa.binary()), ("n", pa.int64())])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids, off, raw = _open(row)
            at = _samples(off, raw, length)
            at = at[_returned(fingerprints(raw, at, length - V + 1), bits, row["found"])]
            start, end = _places(off)
            reach = np.zeros(len(raw) + 1, np.int32)
            np.add.at(reach, np.maximum(at - V + 1, start[at]), 1)
            np.add.at(reach, at + 1, -1)
            want = (np.cumsum(reach[:-1]) > 0) & (np.arange(len(raw)) + length <= end)
            docs = np.flatnonzero(np.add.reduceat(np.r_[want, False], np.minimum(off[:-1], len(want))) * (np.diff(off) > 0)) if len(ids) else np.zeros(0, int)
            if len(docs):
                pick = np.concatenate([np.arange(off[d], off[d + 1]) for d in docs])
                out = _block(row["block"], ids[docs].tolist(), np.diff(off)[docs].tolist(), raw[pick].tobytes())
                mask = want[pick]
                yield pa.RecordBatch.from_pylist([out | {"mask": pa.compress(np.packbits(mask).tobytes(), "zstd", asbytes=True), "n": int(mask.sum())}], schema)

    return _back(shared, blocks).mapInArrow(keep, _BLOCKS + ", mask binary, n long")


def _wanted(row: dict, raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    packed = np.frombuffer(pa.decompress(row["mask"], (len(raw) + 7) // 8, "zstd", asbytes=True), np.uint8)
    at = np.flatnonzero(np.unpackbits(packed, count=len(raw)))
    return at, fingerprints(raw, at, length)


def later_suffixes(left: DataFrame, bits: int, length: int) -> DataFrame:
    """(block, bucket, bits): which suffixes have an equal that starts earlier."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids, off, raw = _open(row)
            at, h = _wanted(row, raw, length)
            doc = np.searchsorted(off, at, "right") - 1
            order, cut = _dealt(h, bits)
            h, doc = h[order], doc[order]
            own = np.flatnonzero(np.diff(cut))
            docs, counts = zip(*(np.unique(doc[cut[b] : cut[b + 1]], return_counts=True) for b in own), strict=True) if len(own) else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array([row["block"]] * len(own), pa.int64()), pa.array([h[cut[b] : cut[b + 1]].tobytes() for b in own], pa.binary()), pa.array([ids[d].tobytes() for d in docs], pa.binary()), pa.array([c.astype("<u4").tobytes() for c in counts], pa.binary())], names=["bucket", "block", "h", "docs", "counts"])

    def sort(rows: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, "<u8") for x in rows["h"].to_pylist()]
        h = np.concatenate(parts)
        doc = np.concatenate([np.repeat(np.frombuffer(d, "<i8"), np.frombuffer(c, "<u4")) for d, c in zip(rows["docs"].to_pylist(), rows["counts"].to_pylist(), strict=True)])
        by_doc = np.argsort(doc, kind="stable")  # a text is in one block, its places ascend there
        order = by_doc[np.argsort(h[by_doc], kind="stable")]
        later = np.zeros(len(h), bool)
        later[order[1:]] = h[order][1:] == h[order][:-1]
        at = np.cumsum([0, *map(len, parts)])
        return pa.table({"block": rows["block"], "bucket": rows["bucket"], "bits": pa.array([np.packbits(later[a:b]).tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())})

    sent = left.mapInArrow(send, "bucket int, block long, h binary, docs binary, counts binary")
    return sent.groupBy("bucket").applyInArrow(sort, "block long, bucket int, bits binary")


def cut_texts(left: DataFrame, later: DataFrame, bits: int, length: int) -> DataFrame:
    """(doc_id, n_removed, n_spans, kept_sha256, spans): spans are the removed runs as start, end in turn."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids, off, raw = _open(row)
            at, h = _wanted(row, raw, length)
            at = at[_returned(h, bits, row["found"])]
            step = np.zeros(len(raw) + 1, np.int32)
            step[at] += 1
            step[at + length] -= 1
            gone = np.cumsum(step[:-1]) > 0
            out = []
            for d in range(len(ids)):
                g = gone[off[d] : off[d + 1]]
                if g.any():
                    edge = np.flatnonzero(np.diff(np.r_[False, g, False]))
                    out.append((int(ids[d]), int(g.sum()), len(edge) // 2, hashlib.sha256(raw[off[d] : off[d + 1]][~g].tobytes()).hexdigest(), edge.tolist()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "n_removed", "n_spans", "kept_sha256", "spans"])

    return _back(later, left).mapInArrow(cut, "doc_id long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) for every row of ``docs`` (doc_id, text)."""
    if length < V + 8:
        raise ValueError(f"length must be {V + 8} or more")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    facts = written(texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "texts")
    first = written(facts.where(F.col("n_bytes") >= length).groupBy("sha", "n_bytes").agg(F.min("doc_id").alias("first")), "firsts")
    ids = first.select(F.col("first").alias("doc_id"))
    few = ids.limit(IDS_SENT + 1).count() <= IDS_SENT
    chosen = texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")

    blocks = written(chosen.mapInArrow(_blocks, _BLOCKS), "blocks")
    size = blocks.agg(F.sum("size")).first()[0] or 0
    bits = _bits(size * len(COVER) / V)
    left = written(candidates(blocks, written(shared_samples(blocks, bits, length), "shared"), bits, length), "suffixes")
    released(blocks)
    bits = _bits(left.agg(F.sum("n")).first()[0] or 0)
    found = written(cut_texts(left, written(later_suffixes(left, bits, length), "later"), bits, length), "cuts")
    released(left)

    out = facts.join(first, ["sha", "n_bytes"], "left").join(found.withColumnRenamed("doc_id", "id"), F.col("doc_id") == F.col("id"), "left")
    copy = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copy, F.array(zero, F.col("n_bytes"))).otherwise(F.coalesce("spans", F.array().cast("array<bigint>"))).alias("spans"),
    )
