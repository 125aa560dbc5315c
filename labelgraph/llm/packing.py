"""Packing pieces of texts into sequences by a configuration linear program.

Texts become pieces of at most ``capacity`` tokens. Only the histogram of piece
lengths (at most ``capacity`` rows) reaches the driver. There the covering
program over configurations (multisets of lengths that fit) is solved by
multiplicative weights: each round a knapsack dynamic program prices the best
configuration for the current weights, which takes a step and lowers the
weights of the lengths that it covers. The fractional solution is rounded
down, and what is left goes to the fullest configuration with room, or to new
sequences, longest first, in groups of equal sequences. The plan lists groups,
not sequences, so its size depends on the lengths alone (under 14,000 rows for
6,000 to 6e8 sequences); pieces find their place in it by their rank among
pieces of their length.

Lengths are priced in steps of ``GRID`` tokens, rounded up; each configuration
is then filled to its capacity in exact tokens with the longest pieces that fit,
and used only as often as pieces remain.

Edge cases: null or empty text is one piece, its end token; repeated rows are
packed each; equal lengths are placed by their rank; an empty table gives an
empty result; a null doc_id is kept as null; other columns of the input are not used;
a long text is encoded whole, then cut.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written
from .tokens import encoder

CAPACITY, END = 4096, 1
GRID, ROUNDS, EPSILON = 16, 1200, 0.2


def pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, place): place is the rank among the task's pieces of that length."""
    last = int(end).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, seen, task = encoder(tokenizer, path), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                rows = []
                for d, ids in zip(part.column(0).to_pylist(), e.encode(part.column(1).to_pylist()), strict=True):
                    ids += last
                    for k in range(0, len(ids) // 4, capacity):
                        x = ids[4 * k : 4 * (k + capacity)]
                        n = len(x) // 4
                        rows.append((d, k // capacity, k, n, zlib.crc32(x), task, seen[n]))
                        seen[n] += 1
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), *[pa.int64()] * 5), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, task long, place long")


def knapsack(prices: np.ndarray, size: np.ndarray, room: int) -> np.ndarray:
    """How often to take each size for the greatest sum of prices within ``room``."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        k = np.searchsorted(size, c, "right")
        best[c], pick[c] = best[c - 1], -2
        if k:
            value = best[c - size[:k]] + prices[:k]
            j = int(np.argmax(value))
            if value[j] > best[c]:
                best[c], pick[c] = value[j], j
    take, c = np.zeros(len(size), np.int64), room
    while c > 0 and pick[c] != -1:
        if pick[c] == -2:
            c -= 1
        else:
            take[pick[c]] += 1
            c -= size[pick[c]]
    return take


def fractional(size: np.ndarray, demand: np.ndarray, room: int, rounds: int = ROUNDS, eps: float = EPSILON) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often to use them so that each size is covered, by multiplicative weights."""
    weight, cover = np.ones(len(size)), np.zeros(len(size))
    used: dict[bytes, float] = {}
    for _ in range(rounds):
        take = knapsack(weight / demand, size, room)
        on = take > 0
        step = float(np.min(demand[on] / take[on]))
        used[take.tobytes()] = used.get(take.tobytes(), 0.0) + step
        gain = step * take / demand
        cover += gain
        weight *= np.exp(-eps * gain)
        weight /= weight.max()
    scale = max(float(np.quantile(cover, 0.05)), 1e-9)
    return [(np.frombuffer(c, np.int64), x / scale) for c, x in used.items()]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, grid: int = GRID) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rows (length, first rank, end rank, sequences, first sequence, offset), and the number of sequences.

    Rank r of a length goes to the row with first <= r < end: sequence
    first_sequence + (r - first) % sequences, place offset + (r - first) // sequences * length.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    groups: list[list] = []  # [sequences, [(length, times)]]
    if not left:
        return [], 0
    kinds: dict[int, list[int]] = {}
    for n in sorted(left, reverse=True):
        kinds.setdefault(-(-n // grid), []).append(n)
    size = np.array(sorted(kinds))
    rest = np.array([sum(left[n] for n in kinds[k]) for k in size.tolist()], np.int64)
    kind_at = {n: j for j, k in enumerate(size.tolist()) for n in kinds[k]}
    solved = fractional(size, rest.astype(float), capacity // grid)
    has = np.zeros(capacity + 1, bool)
    has[list(left)] = True
    for take, x in sorted(solved, key=lambda s: (-s[1], s[0].tobytes())):
        wanted = int(np.floor(x + 1e-9))
        on = np.flatnonzero(take).tolist()
        while wanted and all(rest[j] >= take[j] for j in on):
            content: dict[int, int] = {}
            for j in on:
                need = int(take[j])
                for n in kinds[int(size[j])]:
                    got = min(need, left[n])
                    if got:
                        content[n], need = got, need - got
            # Rounding leaves room: the longest pieces that fit it come in at once.
            free = capacity - sum(n * t for n, t in content.items())
            n = free
            while n > 0 and has[1 : n + 1].any():
                n -= int(np.argmax(has[n:0:-1]))
                got = min(free // n, left[n] - content.get(n, 0))
                if got:
                    content[n] = content.get(n, 0) + got
                    free -= n * got
                n = min(n - 1, free)
            times = min(wanted, *(left[n] // t for n, t in content.items()))
            wanted -= times
            for n, t in content.items():
                left[n] -= times * t
                has[n] = left[n] > 0
                rest[kind_at[n]] -= times * t
            groups.append([times, list(content.items())])
    # What is left: best fit by counts, longest first.
    room: dict[int, list[list]] = {}
    open_ = np.zeros(capacity + 1, bool)

    def put(g: list) -> None:
        r = capacity - sum(n * t for n, t in g[1])
        room.setdefault(r, []).append(g)
        open_[r] = True

    for g in groups:
        put(g)
    for n in sorted(left, reverse=True):
        c = left[n]
        while c:
            fit = int(np.argmax(open_[n:])) + n
            if open_[fit]:
                g = room[fit].pop()
                open_[fit] = bool(room[fit])
            else:
                g, fit = [max(1, c // (capacity // n)), []], capacity
            each = min(fit // n, c)
            t = min(g[0], c // each)
            if g[0] > t:
                put([g[0] - t, list(g[1])])
            put([t, [*g[1], (n, each)]])
            c -= t * each
    rows, seen, base = [], Counter(), 0
    for gs in room.values():
        for count, content in gs:
            at = 0
            for n, t in content:
                rows.append((n, seen[n], seen[n] + count * t, count, base, at))
                seen[n] += count * t
                at += n * t
            base += count
    return sorted(rows), base


def pack(docs: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece and its place."""
    spark = docs.sparkSession
    cut = written(pieces(docs, capacity=capacity, **options), "pieces")
    counts = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    rows, _ = plan(histogram, capacity)
    table = spark.sparkContext.broadcast(np.array(rows, np.int64).reshape(-1, 6))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        key = t[:, 0] << 44 | t[:, 1]  # ranks below 2**44
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            row = t[np.searchsorted(key, length << 44 | rank, "right") - 1]
            r = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(row[:, 4] + r % row[:, 3]), pa.array(row[:, 5] + r // row[:, 3] * length)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    # The counts have a row for each task and length, so they grow with the tasks: sorted and merged, never sent whole.
    ranked = cut.join(counts.select("task", "length", "before").hint("merge"), ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
