"""Language identification by the nearest of several centroids per language.

A text is a vector of hashed byte n-grams (1 to 3 bytes; ASCII letters
lower-cased, all other ASCII characters one separator) with weight
sqrt(count) * idf, scaled to length 1. Each language has up to ``clusters``
centroids from spherical k-means. The nearest centroid by cosine gives the
language. A prediction is rejected if its cosine is below the floor of its
language for texts of that length. Floors are measured on whole training texts
by centroids fitted without them: the texts are dealt to two halves by their
bytes, copies together, and each half is scored by the centroids of the other.

Training uses a bounded sample: about ``per_language`` labelled texts of each
language, picked by a hash of doc_id. Everything else covers all rows.

Edge cases: null, empty or letterless text gets ``und``, score 0, rejected; rows
with null lang are predicted but not learned; repeated rows are predicted alike;
with no labelled text at all every row is ``und``; equal cosines go to the
language that sorts first; a language whose texts all fall in one half takes the
least floors of the others, 0 if there are none; columns called like the added
ones are replaced; an empty table gives an empty result; a long text is one row
of counts, worked on whole in arrays of some 60 bytes a byte of it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .store import bounded_batches, written
from .words import chunks, parts, text_buffers

PER_LANGUAGE = 600
CLUSTERS = 3
DIMS = 8192
#: Up to so many languages their sampling rates go to the scan instead of being joined.
LANGUAGES_SENT = 10_000
#: Quantile of the cosines of texts not fitted on below which a text is rejected.
FLOOR = 0.005
#: Texts a length is measured on; where fewer have it, starts of longer texts and then shorter texts are added.
ENOUGH = 200
_WORD = re.compile(r"[^\W\d_]+")  # letters, and a few signs such as ² that are none

_CLASS = np.full(256, 32, np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def features(off: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """sqrt of n-gram counts, (texts, DIMS); grams never cross texts."""
    n = len(off) - 1
    out = np.zeros(n * DIMS, np.float32)
    b = _CLASS[raw].astype(np.int64)
    doc = np.repeat(np.arange(n, dtype=np.int64) * DIMS, np.diff(off))
    if len(b):
        out += np.bincount(doc + b, minlength=n * DIMS)
    if len(b) > 1:
        two = (b[:-1] * 197 + b[1:] * 31) % 2039 + 256
        same = doc[:-1] == doc[1:]
        out += np.bincount((doc[:-1] + two)[same], minlength=n * DIMS)
    if len(b) > 2:
        three = (b[:-2] * 7919 + b[1:-1] * 1031 + b[2:] * 37) % 5881 + 2304
        same = doc[:-2] == doc[2:]
        out += np.bincount((doc[:-2] + three)[same], minlength=n * DIMS)
    out = np.sqrt(out.reshape(n, DIMS), dtype=np.float32)
    out[:, 32] = 0  # the separator alone tells nothing
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the first centres are the mean and far texts, past the farthest 2 %, each of which would keep a centroid for itself."""
    centres = [_unit(x.mean(0, keepdims=True))[0]]
    while len(centres) < min(k, len(x)):
        centres.append(x[np.argsort(np.max(x @ np.array(centres).T, 1), kind="stable")[len(x) // 50]])
    c = np.array(centres)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, 1)
        c = _unit(np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))]))
    return c.astype(np.float32)


def _bucket(n_bytes: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n_bytes, 1)).astype(int), 14)


def _floors(off: np.ndarray, raw: np.ndarray, x: np.ndarray, idf: np.ndarray, clusters: int) -> list[float]:
    """The floor of each length (2**e bytes and more) of one language; NaN if no text can be left out."""
    n_bytes = np.diff(off)
    half = np.array([zlib.crc32(raw[a:b]) & 1 for a, b in zip(off, off[1:], strict=False)])
    if half.min() == half.max():
        return [float("nan")] * 15
    other = [_kmeans(x[half != h], clusters) for h in (0, 1)]
    whole = np.where(half == 0, (x @ other[0].T).max(1), (x @ other[1].T).max(1))
    bucket = _bucket(n_bytes)
    floors = []
    for e in range(15):
        got = whole[bucket == e]
        longer = np.flatnonzero(bucket > e)
        if len(got) < ENOUGH and len(longer):
            pick = longer[np.unique(np.linspace(0, len(longer) - 1, ENOUGH - len(got)).astype(int))]
            at = off[pick][:, None] + np.arange(1 << e)
            for lo in range(0, len(pick), 32):
                starts = _unit(features(np.arange(len(at[lo : lo + 32]) + 1) << e, raw[at[lo : lo + 32].ravel()]) * idf)
                own = half[pick[lo : lo + 32]]
                got = np.append(got, np.where(own == 0, (starts @ other[0].T).max(1), (starts @ other[1].T).max(1)))
        if len(got) < ENOUGH:
            shorter = np.flatnonzero(bucket < e)
            got = np.append(got, whole[shorter[np.argsort(-n_bytes[shorter], kind="stable")][: ENOUGH - len(got)]])
        floors.append(float(np.quantile(got, FLOOR)))
    return floors


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, clusters: int = CLUSTERS) -> dict:
    """The model of ``labelled`` (doc_id, text, lang): idf, centroids, their languages, floors."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rate = rows.groupBy("lang").agg((F.lit(float(per_language << 20)) / F.count("*")).alias("rate"))
    few = rate.limit(LANGUAGES_SENT + 1).count() <= LANGUAGES_SENT
    picked = rows.join(F.broadcast(rate) if few else rate, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("rate"))
    sample = written(picked.select("lang", "text"), "langs")

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS, np.int64), 0
        for batch in parts(batches):
            off, raw = text_buffers(batch.column(0))
            for lo, hi in chunks(off, rows=128):
                df += (features(off[lo : hi + 1] - off[lo], raw[off[lo] : off[hi]]) > 0).sum(0)
                n += hi - lo
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([df.tobytes()], pa.binary())], names=["n", "df"])

    counted = sample.select("text").coalesce(4).mapInArrow(frequency, "n long, df binary").collect()
    total = sum(p["n"] for p in counted)
    df = sum((np.frombuffer(p["df"], np.int64) for p in counted), np.zeros(DIMS, np.int64))
    idf = np.where(df > 0, np.log((total + 1) / (df + 0.5)), 0).astype(np.float32)

    def train(key: tuple, rows: pa.Table) -> pa.Table:
        off, raw = text_buffers(rows["text"])
        x = np.concatenate([_unit(features(off[lo : hi + 1] - off[lo], raw[off[lo] : off[hi]]) * idf) for lo, hi in chunks(off, rows=128)])
        c = _kmeans(x, clusters)
        floors = _floors(off, raw, x, idf, clusters)
        return pa.table({"lang": pa.array([key[0].as_py()] * len(c)), "centre": pa.array([r.tobytes() for r in c], pa.binary()), "floors": pa.array([floors] * len(c), pa.list_(pa.float64()))})

    got = sorted(sample.groupBy("lang").applyInArrow(train, "lang string, centre binary, floors array<double>").collect(), key=lambda r: (r["lang"], r["centre"]))
    centres = np.array([np.frombuffer(r["centre"], np.float32) for r in got]) if got else np.zeros((0, DIMS), np.float32)
    floors = np.array([r["floors"] for r in got]).reshape(len(got), 15)
    alone = np.isnan(floors[:, 0])
    if alone.any():
        floors[alone] = floors[~alone].min(0) if not alone.all() else 0.0
    return {"idf": idf, "centres": centres, "langs": [r["lang"] for r in got], "floors": floors}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` (with text) plus lang_pred, score, rejected; columns of these names are replaced."""
    idf, centres, langs, floors = model["idf"], model["centres"], model["langs"], model["floors"]
    added = [("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())]
    kept = [c for c in docs.columns if c not in dict(added)]
    shared = docs.sparkSession.sparkContext.broadcast(centres)
    at_text = kept.index("text")
    bounded_batches(docs.sparkSession)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in parts(batches):
            texts = batch.column(at_text)
            off, raw = text_buffers(texts)
            pred, score = np.zeros(len(texts), int), np.zeros(len(texts))
            if len(c):
                for lo, hi in chunks(off, rows=128):
                    x = features(off[lo : hi + 1] - off[lo], raw[off[lo] : off[hi]])
                    x *= idf
                    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
                    cosine = (x @ c.T) / np.maximum(norm, 1e-9)[:, None]
                    pred[lo:hi], score[lo:hi] = np.argmax(cosine, 1), np.clip(cosine.max(1), 0, 1)
            with_letters = np.fromiter(map(lettered, texts.to_pylist()), bool, len(texts)) & bool(len(c))
            rejected = ~with_letters
            if len(c):
                rejected |= score < floors[pred, _bucket(np.diff(off))]
            names = [langs[p] if ok else "und" for p, ok in zip(pred, with_letters, strict=True)]
            cols = [*batch.columns, pa.array(names, pa.string()), pa.array(np.where(with_letters, score, 0.0)), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, *(n for n, _ in added)])

    schema = StructType([*docs.select(*kept).schema.fields, *StructType.fromDDL("lang_pred string, score double, rejected boolean").fields])
    return docs.select(*kept).mapInArrow(label, schema)


def lettered(text: str | None) -> bool:
    """Has the text a letter (Unicode L)?"""
    return any(any(map(str.isalpha, m[0])) for m in _WORD.finditer(text or ""))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_language(docs: DataFrame, **options) -> DataFrame:
    """Fit on the labelled rows that are not held out, predict all: docs + lang_pred, score, rejected."""
    return predict(docs, fit(docs.where(~held_out()).select("doc_id", "text", "lang"), **options))
