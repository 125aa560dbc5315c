"""Secret scan with probabilistic automata inferred from labelled credentials.

Base rules (fixed formats ``assign``, ``access``, ``hex``) find credentials in
whole texts. A bounded sample of their values, labelled by rule, trains one
automaton per kind: the prefix tree of the values, whose states are merged
where their outgoing and ending frequencies agree within a Hoeffding bound
(red-blue order, folding subtrees to stay deterministic).

All candidates are scored: the base spans, every maximal run of credential
characters outside them, and every letter-and-digit piece of such a run. A score
is the log-likelihood of the characters and of the end, a character. A candidate
becomes a ``format`` span where it is as likely as the labelled values of a kind
and that kind explains it better, by ``MARGIN`` nats, than ordinary text does
(pair frequencies of all characters of all texts outside base spans). A run goes
before its pieces. Candidates have the 6 characters at least that the rules ask of a value.

Edge cases: null text is empty; an empty table gives an empty result; spans count
code points, end exclusive; a format span never overlaps a base span; with no
labelled value there are no automata and only base spans, unscored; repeated rows
get the same spans each; between kinds equally likely the first listed is named;
a column called secrets is replaced; a long text is scanned whole, in arrays of
some 60 bytes a byte of it.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .store import bounded_batches, written
from .words import chunks, parts, text_buffers

KINDS = ("assign", "access", "hex", "format")
_ASSIGN = re.compile(rb"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(rb"[0-9a-f]{24,}")
_WORD = re.compile(rb"(?:password|passwd|secret|token|api_?key)\Z", re.I)
#: Labelled values of each kind that train its automaton, at most.
PER_KIND = 400
#: Characters of the shortest value a rule takes, and so of the shortest candidate.
LEAST = 6
#: Confidence of the merge test, and the weight of unseen characters.
ALPHA, UNSEEN = 0.05, 0.02
#: A candidate is accepted down to this far (nats a character) below the labelled values' 2 % quantile.
SLACK = 0.1
#: Nats by which a kind must explain a candidate better than ordinary text: one in a million candidates is a credential.
MARGIN = 13.8

_RUN = np.zeros(256, bool)
_RUN[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-", np.uint8)] = True
_PIECE = _RUN.copy()
_PIECE[np.frombuffer(b"+/_.=-", np.uint8)] = False
_SYMBOLS = 68
#: Number of each credential character from 1; 0 for all others.
_NUMBER = np.cumsum(_RUN) * _RUN


class Automaton:
    """A deterministic probabilistic automaton of byte strings."""

    def __init__(self, values: list[bytes], alpha: float = ALPHA):
        self.next: list[dict[int, int]] = [{}]
        self.times: list[dict[int, int]] = [{}]
        self.ends: list[int] = [0]
        self.alpha = alpha
        for v in values:
            s = 0
            for c in v:
                self.times[s][c] = self.times[s].get(c, 0) + 1
                if c not in self.next[s]:
                    self.next[s][c] = len(self.next)
                    self.next.append({})
                    self.times.append({})
                    self.ends.append(0)
                s = self.next[s][c]
            self.ends[s] += 1
        self._merge()
        self._tables()

    def _seen(self, s: int) -> int:
        return self.ends[s] + sum(self.times[s].values())

    def _alike(self, a: int, b: int) -> bool:
        """Do the two states' frequencies, and those of all their successors, agree?"""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self._seen(a), self._seen(b)
            if not n or not m:
                continue
            bound = math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[a] / n - self.ends[b] / m) > bound:
                return False
            for c in self.times[a].keys() | self.times[b].keys():
                if abs(self.times[a].get(c, 0) / n - self.times[b].get(c, 0) / m) > bound:
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to the states from a on."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            for c, n in self.times[b].items():
                self.times[a][c] = self.times[a].get(c, 0) + n
                if c in self.next[a]:
                    todo.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def _merge(self) -> None:
        red = [0]
        while True:
            reds = set(red)
            blue = [(s, c, t) for s in red for c, t in sorted(self.next[s].items()) if t not in reds]
            if not blue:
                break
            s, c, t = max(blue, key=lambda x: (self._seen(x[2]), -x[0], -x[1]))
            for r in red:
                if self._alike(r, t):
                    self.next[s][c] = r
                    self._fold(r, t)
                    break
            else:
                red.append(t)
        self.states = red

    def _tables(self) -> None:
        order = {s: i for i, s in enumerate(self.states)}
        rest = len(order)  # where characters never seen in a state lead: the state itself stays
        self.to = np.tile(np.arange(rest)[:, None], (1, 256))
        self.log = np.zeros((rest, 256))
        self.end = np.zeros(rest)
        for s, i in order.items():
            n = max(1, self._seen(s))
            self.end[i] = math.log((1 - UNSEEN) * self.ends[s] / n + UNSEEN / _SYMBOLS)
            self.log[i] = math.log(UNSEEN / _SYMBOLS)
            for c, m in self.times[s].items():
                self.log[i, c] = math.log((1 - UNSEEN) * m / n + UNSEEN / _SYMBOLS)
                self.to[i, c] = order[self.next[s][c]]

    def score(self, value: bytes) -> float:
        """Log-likelihood of the characters and the end, a character."""
        raw = np.frombuffer(value, np.uint8)
        return float(self.scores(raw, np.zeros(1, np.int64), np.array([len(raw)]), -np.inf)[0])

    def scores(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, least: float) -> np.ndarray:
        """``score`` of raw[start : end] for all of them at once; -inf once one must stay below ``least``."""
        out = np.full(len(start), -np.inf)
        at, size = np.arange(len(start)), end - start
        state, total = np.zeros(len(start), np.int64), np.zeros(len(start))
        for j in range(int(size.max(initial=0)) + 1):
            over = size[at] == j
            if over.any():
                done = at[over]
                out[done] = (total[over] + self.end[state[over]]) / (j + 1)
                at, state, total = at[~over], state[~over], total[~over]
            if not len(at):
                break
            c = raw[start[at] + j]
            total = total + self.log[state, c]
            state = self.to[state, c]
            on = total >= least * (size[at] + 1)
            if not on.all():
                at, state, total = at[on], state[on], total[on]
        return out


@dataclass
class Model:
    """Automata and least scores by kind, and log frequencies of pairs of characters in ordinary text."""

    automata: dict[str, tuple[Automaton, float]]
    pairs: np.ndarray


def _edges(ok: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal runs of ``ok`` inside texts."""
    if not len(ok):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(ok) + 1, bool)
    cut[off] = True
    start = np.flatnonzero(ok & (np.r_[True, ~ok[:-1]] | cut[:-1]))
    end = np.flatnonzero(ok & (np.r_[~ok[1:], True] | cut[1:])) + 1
    return start, end


def base_spans(off: np.ndarray, raw: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text, start, kind, end, start of the value) in order; bytes from the first text's start."""
    data = raw.tobytes()
    found = []
    last_doc, done = -1, 0
    for p in np.flatnonzero((raw == 58) | (raw == 61)).tolist():
        d = int(np.searchsorted(off, p, "right")) - 1
        base = int(off[d])
        if d != last_doc:
            last_doc, done = d, base
        q = p
        while q > base and data[q - 1] == 32:
            q -= 1
        if q > base and data[q - 1] in b"\"'":
            q -= 1
        word = _WORD.search(data, max(base, q - 8), q)
        if not word or word.start() < done:
            continue
        m = _ASSIGN.match(data, word.start(), int(off[d + 1]))
        if m:
            done = m.end()
            if len(m[2]) >= 6:
                found.append((d, m.start(), 0, m.end(), m.start(2)))
    start, end = _edges(_RUN[raw], off)
    long = end - start >= 20
    for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True):
        for kind, rule in ((1, _ACCESS), (2, _HEX)):
            for m in rule.finditer(data, a, b):
                found.append((int(np.searchsorted(off, a, "right")) - 1, m.start(), kind, m.end(), m.start()))
    return sorted(found)


def _outside(raw: np.ndarray, spans: list) -> np.ndarray:
    """Credential characters outside the base spans."""
    ok = _RUN[raw]
    for _, s, _, e, _ in spans:
        ok[s:e] = False
    return ok


def counted_values(docs: DataFrame) -> DataFrame:
    """(kind, value, n): base matches of kinds 0 to 2, and as kind 3 the pairs of character numbers outside them, of all texts."""
    bounded_batches(docs.sparkSession)
    size = _SYMBOLS + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(size * size, np.int64)
        for batch in parts(batches):
            off, raw = text_buffers(batch.column(0))
            got: Counter = Counter()
            for lo, hi in chunks(off):
                at, data = off[lo : hi + 1] - off[lo], raw[off[lo] : off[hi]]
                spans = base_spans(at, data)
                got.update((k, data[v:e].tobytes()) for _, _, k, e, v in spans)
                number = np.r_[0, np.insert(_NUMBER[data] * _outside(data, spans), at[1:], 0)]
                pairs += np.bincount(number[:-1] * size + number[1:], minlength=size * size)
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int32()), pa.array([v for _, v in got], pa.binary()), pa.array(list(got.values()), pa.int64())], names=["kind", "value", "n"])
        seen = np.flatnonzero(pairs[1:]) + 1  # the first pair is no character after none
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array([3] * len(seen), pa.int32()), pa.array([bytes(divmod(x, size)) for x in seen.tolist()], pa.binary()), pa.array(pairs[seen])], names=["kind", "value", "n"])

    return docs.select("text").mapInArrow(count, "kind int, value binary, n long").groupBy("kind", "value").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, per_kind: int = PER_KIND) -> Model:
    """The model of the base matches in ``docs``; all characters count, at most ``per_kind`` values a kind train."""
    counted = written(counted_values(docs), "values")
    by: dict[int, list[bytes]] = defaultdict(list)
    for k in (0, 1, 2):
        for row in counted.where(F.col("kind") == k).orderBy(F.xxhash64("value"), "value").limit(per_kind).collect():
            by[k].append(bytes(row["value"]))
    size = _SYMBOLS + 1
    pairs = np.ones((size, size))
    for row in counted.where("kind = 3").collect():  # size * size rows at most
        pairs[row["value"][0], row["value"][1]] += row["n"]
    automata = {}
    for kind, values in sorted(by.items()):
        automaton = Automaton(sorted(values))
        automata[KINDS[kind]] = (automaton, float(np.quantile([automaton.score(v) for v in values], 0.02)) - SLACK)
    return Model(automata, np.log(pairs / pairs.sum(1, keepdims=True)))


def _likely(off: np.ndarray, raw: np.ndarray, spans: list, model: Model) -> list[tuple[int, int, int, str, float]]:
    """(text, start, end, likest kind, score) of the accepted candidates."""
    ok = _outside(raw, spans)
    number = _NUMBER[raw]
    step = np.zeros(len(raw) + 1)
    if len(raw):
        np.cumsum(model.pairs[number[:-1], number[1:]], out=step[1:-1])
    out: list[tuple[int, int, int, str, float]] = []
    taken = np.zeros(len(raw), bool)
    for mask in (ok, ok & _PIECE[raw]):
        start, end = _edges(mask, off)
        keep = end - start >= LEAST
        start, end = start[keep], end[keep]
        if mask is not ok and len(start):  # pieces of runs that are not accepted, and no whole runs again
            keep = ~taken[start] & ~((np.r_[False, ok][start] == 0) & (np.r_[ok, False][end] == 0))
            start, end = start[keep], end[keep]
        if not len(start):
            continue
        usual = step[end - 1] - step[start] + model.pairs[0, number[start]] + model.pairs[number[end - 1], 0]
        best, kind = np.full(len(start), -np.inf), np.zeros(len(start), int)
        names = list(model.automata)
        for k, name in enumerate(names):
            automaton, least = model.automata[name]
            score = automaton.scores(raw, start, end, least)
            score[(score < least) | (score * (end - start + 1) - usual < MARGIN)] = -np.inf
            better = score > best
            best[better], kind[better] = score[better], k
        for i in np.flatnonzero(best > -np.inf).tolist():
            taken[start[i] : end[i]] = True
            out.append((int(np.searchsorted(off, start[i], "right")) - 1, int(start[i]), int(end[i]), names[kind[i]], float(best[i])))
    return out


def find_secrets(docs: DataFrame, model: Model | None = None, replace: str | None = None) -> DataFrame:
    """``docs`` (with text) plus ``secrets``: array of (kind, start, end, likest, score), by start, then kind.

    With ``replace`` every span of the returned text is replaced by it in the same pass.
    """
    model = fit(docs) if model is None else model
    kept = [c for c in docs.columns if c != "secrets"]
    at = kept.index("text")
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("likest", pa.string()), ("score", pa.float64())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in parts(batches):
            off, raw = text_buffers(batch.column(at))
            out: list[list[dict]] = [[] for _ in range(len(batch))]
            for lo, hi in chunks(off):
                part, data = off[lo : hi + 1] - off[lo], raw[off[lo] : off[hi]]
                spans = base_spans(part, data)
                rows: dict[int, list] = defaultdict(list)
                for d, s, k, e, v in spans:
                    own = model.automata.get(KINDS[k])
                    rows[d].append((s, k, e, KINDS[k] if own else None, own[0].score(data[v:e].tobytes()) if own else None))
                if model.automata:
                    for d, s, e, m, x in _likely(part, data, spans, model):
                        rows[d].append((s, 3, e, m, x))
                for d, found in rows.items():
                    base = part[d]
                    points = np.r_[0, np.cumsum((data[base : part[d + 1]] & 0xC0) != 0x80)]  # code points before each byte
                    out[lo + d] = [{"kind": KINDS[k], "start": int(points[s - base]), "end": int(points[e - base]), "likest": m, "score": x} for s, k, e, m, x in sorted(found, key=lambda r: r[:3])]
            if replace is not None:
                batch = batch.set_column(at, kept[at], _replaced(batch.column(at), out, replace))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(item))], names=[*kept, "secrets"])

    added = StructType.fromDDL("secrets array<struct<kind:string,start:bigint,end:bigint,likest:string,score:double>>")
    schema = StructType([*docs.select(*kept).schema.fields, *added.fields])
    return docs.select(*kept).mapInArrow(mark, schema)


def _replaced(texts: pa.Array, found: list[list[dict]], mark: str) -> pa.Array:
    if not any(found):
        return texts
    texts = texts.to_pylist()
    for i, spans in enumerate(found):
        if spans:
            kept, at = [], 0
            for s in spans:
                if s["end"] > at:
                    kept += [texts[i][at : max(at, s["start"])], mark if s["start"] >= at else ""]
                    at = s["end"]
            texts[i] = "".join(kept) + texts[i][at:]
    return pa.array(texts, pa.string())


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret span of text replaced by ``mark``; needs find_secrets' ``secrets``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", _replaced(batch.column(at), batch.column("secrets").to_pylist(), mark))

    return docs.mapInArrow(cut, docs.schema)
