"""Whole-text encoding with public tokenizer files, through a cache of words.

Both vocabularies split a text into pre-tokens by a fixed pattern and encode
each alone, so a text's ids are those of its pre-tokens in order. Texts whose
characters all lie in the Latin blocks are split here by the same pattern and
looked up in a cache bounded in bytes; unknown pre-tokens, and all other texts
whole, go to the tokenizers library, with its settings as the file has them. A
text that holds the string of an added token (in any case) always goes whole.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
from array import array

import numpy as np

#: Bytes, estimated, of each of a worker's two caches; beyond that the newer becomes the older one.
CACHE = 112 << 20
#: What an entry of a cache takes besides its characters and ids.
_ENTRY = 190

# The letters and numbers (Unicode L and N) below U+0250, and the two pre-token patterns.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
_PATTERNS = {
    "byte_bpe_50k.json": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+"),
    "word_bpe_49k.json": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+"),
}
#: Characters on which pattern classes or case could differ between libraries.
_OTHER = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e\xa1-įı-ɏ]")


class Encoder:
    def __init__(self, name: str, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(path)
        added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.added = re.compile("|".join(map(re.escape, added)), re.I) if added else None
        self.mark = re.match(r"[^A-Za-z]*", os.path.commonprefix(added))[0] if added else ""  # how all of them begin, without letters
        self.pattern = _PATTERNS.get(name)
        self.lower = name.startswith("word")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word, or that break words
        self.ends[[i for t, i in vocabulary.items() if (t.endswith("</w>") if self.lower else t == "Ċ")]] = True
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # the cache before this one
        self.held = 0  # bytes of the newer cache

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null counts as empty."""
        out: list[bytes | None] = [b""] * len(texts)
        split: list[tuple[int, list[str]]] = []
        for i, text in enumerate(texts):
            if text and (self.pattern is None or _OTHER.search(text) or (self.added and self.mark in text and self.added.search(text))):
                out[i] = self.whole([text])[0]
            elif text:
                split.append((i, self.pattern.findall(text.lower() if self.lower else text)))
        if self.held > CACHE:
            self.old, self.cache, self.held = self.cache, {}, 0
        new = set().union(*(w for _, w in split)).difference(self.cache)
        if new:
            met = new.intersection(self.old)
            rest = list(new.difference(met) if met else new)
            known = dict(zip(rest, self._each(rest), strict=True))
            known.update(zip(met, map(self.old.__getitem__, met), strict=True))
            self.cache.update(known)
            self.held += _ENTRY * len(known) + sum(map(len, known)) + sum(map(len, known.values()))
        get = self.cache.__getitem__
        for i, words in split:
            out[i] = b"".join(map(get, words))
        return out

    def _each(self, words: list[str]) -> list[bytes]:
        """Ids of each pre-token: all in one text, a line break between two, cut at the ids that end words.

        Pre-tokens of white space would join the breaks and are encoded alone.
        """
        solid = [w for w in words if not w.isspace()]
        found: dict[str, bytes] = {}
        if solid:
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(solid)], add_special_tokens=False)[0].ids, "<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            if self.lower:
                at = np.c_[np.r_[0, last[:-1]], last]  # a word's last id is marked, breaks have none
            else:
                at = np.c_[np.r_[0, last], np.r_[last - 1, len(ids)]]  # breaks have an id of their own
            if len(at) == len(solid):
                raw = ids.tobytes()
                a, b = (4 * at).T.tolist()
                found = dict(zip(solid, map(raw.__getitem__, map(slice, a, b)), strict=True))
        rest = [w for w in words if w not in found]
        if rest:
            found.update(zip(rest, self.whole(rest), strict=True))
        return list(map(found.__getitem__, words))


_encoders: dict[tuple, Encoder] = {}


def encoder(name: str, path: str | None = None) -> Encoder:
    """This worker's encoder; it keeps one at a time, and returns free memory before it loads another."""
    if (name, path) not in _encoders:
        _encoders.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)
        _encoders[name, path] = Encoder(name, path)
    return _encoders[name, path]
