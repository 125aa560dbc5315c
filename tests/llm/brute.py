"""Plain versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_RULES = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}


def secrets(text):
    out = []
    for k, (kind, rule) in enumerate(_RULES.items()):
        for m in rule.finditer(text or ""):
            if {"assign": len(m[m.lastindex or 0]) >= 6, "access": len(m[0]) >= 20, "hex": len(m[0]) >= 24}[kind]:
                out.append((m.start(), k, m.end(), kind))
    return [f"{kind}:{s}:{e}" for s, _, e, kind in sorted(out)]


def shingles(text):
    w = _WORD.findall((text or "").translate(_LOW))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def components(docs):
    sets = {d: shingles(t) for d, t in docs}
    own = {d: d for d in sets}

    def root(d):
        while own[d] != d:
            d = own[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((root(a), root(b)))
                own[q] = p
    return {d: (len(sets[d]), root(d)) for d in ids}


def repeats(docs, length=100):
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(b[i : i + length])
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def rules(text):
    text = text or ""
    w = _WORD.findall(text)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    twice = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(twice)


def licenses(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOW))
    at, labels = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def passages(docs, window=20):
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda r: r[0]):
        w = _WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if tuple(w[i : i + window]) in seen:
                gone[i : i + window] = [True] * window
            seen.add(tuple(w[i : i + window]))
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def search(docs, items, k=10):
    term = lambda t: [w.translate(_LOW) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    tf = [(d, Counter(term(t))) for d, t in docs]
    tf = [(d, c) for d, c in tf if c]
    df = Counter(w for _, c in tf for w in c)
    total = sum(sum(c.values()) for _, c in tf)
    out = []
    for item, text in items:
        scores = []
        for d, c in tf:
            m = 25 + 75 * sum(c.values()) * len(tf) // total
            s = sum(math.floor(1000 * math.log((2 * len(tf) + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in term(text) if w in c)
            scores += [(-s, d is None, d)] if s > 0 else []
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def merged(docs):
    """(doc_id, lang, source, sha256 of text, counts) of the merge of branches L and R, doc by doc."""
    code = lambda b, d, n: zlib.crc32(f"{b}:{d}:{n}".encode()) % 7
    mark = {1: "!", 2: "?", 3: "!", 4: "?"}
    sha = lambda lines: hashlib.sha256("\n".join(lines).encode()).hexdigest()
    out = []
    for d, text, lang, source in docs:
        base = {"lang": lang or "", "source": source or ""}
        lines = (text or "").split("\n")
        side = {}
        for b in "LR":
            cols = {c: "" if code(b, d, c) == 0 else v + mark[code(b, d, c)] if code(b, d, c) in (1, 2) else v for c, v in base.items()}
            own = [None if code(b, d, i) == 0 else x + mark[code(b, d, i)] if code(b, d, i) in (1, 2) else x for i, x in enumerate(lines)]
            gaps = [mark[code(b, d, i)] if code(b, d, i) in (3, 4) else None for i in range(len(lines))]
            side[b] = (cols, own, gaps, code(b, d, "row"))
        added = [mark[side[b][3]] if side[b][3] in (3, 4) else None for b in "LR"]
        if any(added):
            clash = all(added) and added[0] != added[1]
            out.append((-1 - d, base["lang"], base["source"], sha([added[1] or added[0]]), int(not clash), 0, 0, int(clash)))
        changed = {b: side[b][:3] != (base, lines, [None] * len(lines)) for b in "LR"}
        gone = [b for b in "LR" if side[b][3] == 0]
        if gone:
            clash = len(gone) == 1 and changed["R" if gone == ["L"] else "L"]
            if clash and gone == ["L"]:
                cols, own, gaps, _ = side["R"]
                text = [x for pair in zip(own, gaps, strict=True) for x in pair if x is not None]
                out.append((d, cols["lang"], cols["source"], sha(text), 0, 0, 1, 0))
            else:
                out.append((d, None, None, None, int(not clash), 0, int(clash), 0))
            continue
        n = [0, 0, 0, 0]

        def merge(b, x, y, kind):
            if x != b or y != b:
                n[0 if x == b or y == b or x == y else kind] += 1
            return x if y == b else y

        (lc, lo, lg, _), (rc, ro, rg, _) = side["L"], side["R"]
        cols = {c: merge(v, lc[c], rc[c], 1) for c, v in base.items()}
        text = []
        for i, x in enumerate(lines):
            text += [t for t in (merge(x, lo[i], ro[i], 2 if lo[i] is None or ro[i] is None else 1), merge(None, lg[i], rg[i], 3)) if t is not None]
        out.append((d, cols["lang"], cols["source"], sha(text), *n))
    return out
