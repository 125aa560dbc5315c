"""Static range asymmetric numeral system for token ids, and its shard format.

A shard holds the ids of consecutive documents under one frequency table. They
are cut into blocks of ``STEPS`` x ``LANES`` ids; each block is coded by itself with
``LANES`` interleaved 64-bit states that emit 32-bit words, so blocks decode in
any order and all lanes of all blocks decode together. The block table holds a
checkpoint for each block (first id, first word) and the CRC-32 of its ids.

Layout, little-endian: header ``_HEAD``; doc ids (i8); ids of each document (u4);
symbols (u4) and frequencies (u4), which sum to 2**SCALE; the block table ``_BLOCK``;
end states (u8, LANES a block); words (u4).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE, LANES, STEPS = 18, 256, 512
_MAGIC = b"LGRANS01"
_HEAD = struct.Struct("<8sQQIIII")
_BLOCK = np.dtype([("first", "<u8"), ("n", "<u4"), ("word", "<u8"), ("words", "<u4"), ("crc", "<u4")])
_LOW = np.uint64(1 << 31)
_U = np.uint64


def table(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies of at least 1 that sum to 2**scale, in proportion to ``counts`` (all > 0)."""
    total = 1 << scale
    if len(counts) > total:
        raise ValueError("more symbols than the scale holds")
    f = np.maximum(1, np.floor(counts * (total / counts.sum())).astype(np.int64))
    while (over := int(f.sum()) - total) != 0:
        big = np.argsort(-f, kind="stable")
        if over < 0:
            f[big[0]] -= over
        else:
            big = big[f[big] > 1][:over]
            f[big] -= 1
    return f.astype(np.uint64)


def encode(ids: np.ndarray, freq: np.ndarray, start: np.ndarray, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end states (blocks, lanes), words, words a block) of symbol numbers ``ids``."""
    size = LANES * STEPS
    blocks = max(1, -(-len(ids) // size))
    steps = min(STEPS, max(1, -(-len(ids) // LANES)))
    grid = np.zeros(blocks * steps * LANES, np.int64)
    grid[: len(ids)] = ids
    grid = grid.reshape(blocks, steps, LANES)
    x = np.full((blocks, LANES), _LOW)
    emitted = np.zeros((blocks, steps, LANES), bool)
    words = np.zeros((blocks, steps, LANES), np.uint32)
    limit = freq << _U(63 - scale)
    for t in range(steps - 1, -1, -1):
        s = grid[:, t]
        out = x >= limit[s]
        emitted[:, t] = out
        words[:, t] = x.astype(np.uint32)
        x = np.where(out, x >> _U(32), x)
        f = freq[s]
        q = x // f
        x = (q << _U(scale)) + (x - q * f) + start[s]
    return x, words[emitted], emitted.sum((1, 2))


def decode(states: np.ndarray, words: np.ndarray, first: np.ndarray, n: np.ndarray, freq: np.ndarray, start: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Symbol numbers of the blocks with these end states; ``first``: each block's first word, ``n``: its ids."""
    steps = max(1, -(-int(n.max()) // LANES))
    slots = np.repeat(np.arange(len(freq), dtype=np.int32), freq.astype(np.int64))
    x, at = states.copy(), first.astype(np.int64)
    out = np.empty((len(states), steps, LANES), np.int32)
    padded = np.r_[words, np.zeros(1, np.uint32)]
    mask = _U((1 << scale) - 1)
    for t in range(steps):
        slot = x & mask
        s = slots[slot]
        out[:, t] = s
        x = freq[s] * (x >> _U(scale)) + slot - start[s]
        need = x < _LOW
        place = np.cumsum(need, axis=1)
        word = padded[np.where(need, np.minimum(at[:, None] + place - 1, len(words)), len(words))]
        x = np.where(need, (x << _U(32)) | word, x)
        at += place[:, -1]
    keep = np.arange(steps * LANES)[None, :] < n[:, None]
    return out.reshape(len(states), -1)[keep]


def pack_shard(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """The shard of the documents' concatenated ids."""
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    symbols = np.flatnonzero(counts)
    freq = table(counts[symbols].astype(np.float64)) if len(symbols) else np.zeros(0, np.uint64)
    start = (np.cumsum(freq) - freq).astype(np.uint64)
    number = np.zeros(len(counts), np.int32)
    number[symbols] = np.arange(len(symbols))
    size = LANES * STEPS
    blocks = -(-len(ids) // size)
    states, words, n_words = encode(number[ids], freq, start) if blocks else (np.zeros((0, LANES), np.uint64), np.zeros(0, np.uint32), np.zeros(0, int))
    index = np.zeros(blocks, _BLOCK)
    for b in range(blocks):
        own = ids[b * size : (b + 1) * size].astype("<u4")
        index[b] = (b * size, len(own), int(n_words[:b].sum()), int(n_words[b]), zlib.crc32(own.tobytes()))
    head = _HEAD.pack(_MAGIC, len(doc_ids), len(ids), len(symbols), blocks, SCALE, LANES)
    parts = (doc_ids.astype("<i8"), lengths.astype("<u4"), symbols.astype("<u4"), freq.astype("<u4"), index, states.astype("<u8"), words.astype("<u4"))
    return head + b"".join(p.tobytes() for p in parts)


def unpack_shard(data: bytes, only: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, lengths, ids); with ``only`` = (a, b) just the ids of blocks a to b, from their checkpoints."""
    magic, n_docs, n_ids, n_symbols, blocks, scale, lanes = _HEAD.unpack_from(data)
    if magic != _MAGIC or lanes != LANES:
        raise ValueError("not a shard of this format")
    at = _HEAD.size

    def take(kind: object, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    doc_ids, lengths, symbols = take("<i8", n_docs), take("<u4", n_docs), take("<u4", n_symbols)
    freq = take("<u4", n_symbols).astype(np.uint64)
    index, states = take(_BLOCK, blocks), take("<u8", blocks * lanes).reshape(blocks, lanes)
    words = take("<u4", (len(data) - at) // 4)
    a, b = only or (0, blocks)
    index = index[a:b]
    if not len(index):
        return doc_ids, lengths, np.zeros(0, np.uint32)
    ids = symbols[decode(states[a:b], words, index["word"], index["n"].astype(np.int64), freq, np.cumsum(freq) - freq, scale)]
    for k in index:
        own = ids[k["first"] - index["first"][0] :][: k["n"]]
        if zlib.crc32(own.tobytes()) != k["crc"]:
            raise ValueError(f"checksum of the block at id {k['first']} differs")
    if only is None and len(ids) != n_ids:
        raise ValueError("shard is incomplete")
    return doc_ids, lengths, ids
