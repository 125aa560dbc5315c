"""Branch merge, ranked search and passage removal against plain versions, and their edge cases."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelgraph.llm.branch_merge import document_lines, merge_branches, merge_documents
from labelgraph.llm.fm_index import FMIndex
from labelgraph.llm.passages import remove_passages
from labelgraph.llm.ranked_search import search
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string"


def digest(merged):
    out = merged.select("doc_id", "lang", "source", F.sha2("text", 256), "n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert")
    return sorted(map(tuple, out.collect()), key=str)


# Branch merge


def test_merge_against_plain_version(spark):
    rng = random.Random(3)
    texts = [None, "", "\n", "a", "a\n\nb", *("\n".join(rng.choice(["x", "", "yé", "z z"]) for _ in range(rng.randint(1, 12))) for _ in range(400))]
    docs = [(i, t, rng.choice(["en", "", None]), rng.choice(["s", None])) for i, t in enumerate(texts)]
    assert digest(merge_documents(spark.createDataFrame(docs, DOCS))) == sorted(brute.merged(docs), key=str)


def test_merge_of_a_long_text(spark):
    docs = [(1, "\n".join(f"line {i}" for i in range(50_000)), "en", "s"), (2, "x" * 2_000_000, "en", "s")]
    assert digest(merge_documents(spark.createDataFrame(docs, DOCS))) == sorted(brute.merged(docs), key=str)


def test_merge_repeated_and_null_ids(spark):
    docs = [(7, "a\nb", "en", "s"), (7, "a\nb", "en", "s"), (7, "c", "de", "s"), (None, "n\nm", None, "t"), (None, "n\nm", None, "t"), (-8, "own", "en", "s")]
    got = digest(merge_documents(spark.createDataFrame(docs, DOCS).withColumn("line_ids", F.lit(1)).withColumn("copy", F.lit("x"))))
    want = brute.merged([d for d in docs if d[0] is not None])
    none = [(None, "", "t", brute.hashlib.sha256(b"n\nm").hexdigest(), 0, 0, 0, 0)] * 2
    assert got == sorted(want + none, key=str)


def test_merge_empty_table(spark):
    assert digest(merge_documents(spark.createDataFrame([], DOCS))) == []


def test_merge_of_free_tables(spark):
    schema = "id long, c string, line_ids array<long>, lines array<string>"
    base = spark.createDataFrame([(1, "x", [1, 2], ["a", "b"]), (2, "x", [1], ["a"]), (3, "x", [1], ["a"]), (4, None, [], [])], schema)
    left = spark.createDataFrame([(1, "y", [9, 1, 2, 5, 6], ["top", None, "B", "i", "j"]), (3, "x", [1], [None]), (4, None, [], []), (5, "n", [1], ["new"])], schema)
    right = spark.createDataFrame([(1, None, [1], ["a"]), (2, "x", [1], ["A"]), (4, "z", [3], ["q"]), (5, "n", [4], ["new"])], schema)
    got = {r[0]: tuple(r)[1:] for r in merge_branches(base, left, right, ["id"], ["c"]).collect()}
    assert got == {
        1: (None, "top\na\ni\nj", 2, 1, 1, 0),  # columns differ; line 2 edited and dropped; two gaps of L
        2: ("x", "A", 0, 0, 1, 0),  # dropped by L, edited by R
        3: (None, None, 1, 0, 0, 0),  # dropped by R, the same in L
        4: ("z", "q", 2, 0, 0, 0),
        5: ("n", "new", 1, 0, 0, 0),
    }


def test_document_lines_number_repeats_only(spark):
    rows = document_lines(spark.createDataFrame([(1, "b", "", ""), (1, "a", "", ""), (2, "a\n", "", "")], DOCS)).collect()
    assert sorted((r.doc_id, r.copy, tuple(r.lines)) for r in rows) == [(1, 0, ("a",)), (1, 1, ("b",)), (2, 0, ("a", ""))]


# Ranked search


def test_search_against_plain_version(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    text = lambda n: " ".join(rng.choices(words, weights, k=n))
    docs = [(i, rng.choice([text(rng.randint(1, 60)), text(300), None, "", "--"]) if i % 9 == 0 else text(40)) for i in range(600)]
    docs += [(600 + i, docs[1][1]) for i in range(30)]
    items = [(i, text(rng.randint(1, 25))) for i in range(30)] + [(30, docs[1][1]), (31, None), (32, "zzz"), (33, "W1 w1, W2!")]
    got = search(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute.search(docs, items))


@pytest.mark.parametrize("shuffled", [False, True])
def test_search_small_bounds(spark, monkeypatch, shuffled):
    from labelgraph.llm import ranked_search

    monkeypatch.setattr(ranked_search, "FIRST", 1)
    if shuffled:
        monkeypatch.setattr(ranked_search, "TERMS_SENT", 1)
        monkeypatch.setattr(ranked_search, "ROWS_SENT", 1)
    rng = random.Random(6)
    text = lambda n: " ".join(f"w{min(rng.randint(0, 40), rng.randint(0, 40))}" for _ in range(n))
    docs = [(i, text(20)) for i in range(300)]
    items = [(i, text(8)) for i in range(12)]
    got = search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute.search(docs, items))


def test_search_ties_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "same words"), (5, "same words"), (5, "same words"), (3, "same words")], "doc_id long, text string").withColumn("term", F.lit(1)).withColumn("row", F.lit(2))
    items = spark.createDataFrame([(1, "same"), (1, "words"), (None, "same")], "item_id long, text string")
    got = [tuple(r)[:3] for r in search(docs, items).collect()]
    one = [(1, 3), (2, 5), (3, 5), (4, None)]
    assert sorted(got, key=str) == sorted([(i, *r) for i in (1, 1, None) for r in one], key=str)


def test_search_empty_tables(spark):
    docs, items = (spark.createDataFrame([], f"{c} long, text string") for c in ("doc_id", "item_id"))
    full = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert search(docs, items).collect() == search(full, items).collect() == search(docs, full.withColumnRenamed("doc_id", "item_id")).collect() == []


# Tables of pages


def test_wide_cells_are_aligned():
    from labelgraph.llm import html_text

    wide = "x" * 90
    page = f"<table><tr><td>{wide}<td>1<tr><td>a<td>22<tr><td>bb<td>3</table>"
    assert html_text.page_text(page).split("\n") == [f"{wide} | 1", f"{'a':90} | 22", f"{'bb':90} | 3"]


def test_padding_is_bounded(monkeypatch):
    from labelgraph.llm import html_text

    monkeypatch.setattr(html_text, "PAD", 100)
    page = "<table>" + f"<tr><td>{'x' * 60}<td>a<td>1" + "<tr><td>y<td>bbb<td>2" + "</table>"
    assert html_text.page_text(page).split("\n") == [f"{'x' * 60} | a   | 1", "y | bbb | 2"]


# Jaccard join


def _family(rng, n, words, edits):
    base = [f"w{i}" for i in range(words)]
    out = []
    for d in range(n):
        w = list(base)
        for at in rng.sample(range(words), edits):
            w[at] = f"x{d}y{at}"
        out.append((d, " ".join(w)))
    return out


def test_template_family_below_the_limit_sends_few_pairs(spark, monkeypatch):
    from labelgraph.llm import ngram_jaccard as J

    sent = []
    plain = J.verified

    def counted(docs, pairs, percent, k):
        sent.append(pairs.count())
        return plain(docs, pairs, percent, k)

    monkeypatch.setattr(J, "verified", counted)
    rng = random.Random(8)
    docs = _family(rng, 300, 200, 3) + [(1000 + d, t) for d, t in _family(random.Random(9), 20, 150, 1)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.ngram_jaccard_join(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)).collect()}
    assert got == brute.components(docs)
    assert sum(sent) < 5000


def test_sketches_never_hide_a_link(spark):
    from labelgraph.llm import ngram_jaccard as J

    rng = np.random.default_rng(3)
    rows, sets = [], []
    for i in range(60):
        base = rng.integers(0, 1 << 63, int(rng.integers(20, 300)), np.uint64)
        for _ in range(2):
            s = np.unique(np.r_[base[rng.random(len(base)) > 0.05], rng.integers(0, 1 << 63, len(base) // 15, np.uint64)])
            sets.append(set(s.tolist()))
            rows.append((len(rows), len(s), J.sketch(s).tolist()))
    pairs = [(2 * i, 2 * i + 1) for i in range(60)] + [(i, j) for i in range(100) for j in range(i + 2, 120) if 100 * min(len(sets[i]), len(sets[j])) >= 80 * max(len(sets[i]), len(sets[j]))]
    kept = {tuple(r) for r in J.sketched(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(rows, "doc_id long, n long, sketch array<long>"), 80).collect()}
    alike = {(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert len(alike) > 10 and alike <= kept and len(kept) < len(alike) + 20


# Passages


def test_index_against_plain_search():
    rng = np.random.default_rng(1)
    streams = [rng.integers(1, 4, n).astype(np.int32) for n in (5, 9, 30, 41, 7)] + [np.ones(25, np.int32)]
    index = FMIndex(np.concatenate([np.r_[np.int32(0), s] for s in streams]), 5)
    found = index.classes(streams)
    windows = [tuple(s[i : i + 5]) for s in streams for i in range(len(s) - 4)]
    classes = np.concatenate(found)
    assert [len(f) for f in found] == [max(0, len(s) - 4) for s in streams]
    assert all((windows[i] == windows[j]) == (classes[i] == classes[j]) for i in range(len(windows)) for j in range(i))


@pytest.mark.parametrize("hot", [0, 64])
def test_passages_against_plain_version(spark, hot):
    rng = random.Random(hot)
    word = lambda n, v: [f"w{rng.randint(0, v)}" for _ in range(n)]
    shared_passages = [word(rng.randint(20, 70), 400) for _ in range(6)]
    docs = []
    for i in range(300):
        w = word(rng.randint(0, 90), 400)
        for _ in range(rng.randint(0, 2)):
            w = w[: (k := rng.randint(0, len(w)))] + rng.choice(shared_passages) + w[k:]
        docs.append((rng.randint(0, 10**12), " ".join(w)))
    docs += [(10**13 + i, "a " * 60) for i in range(3)] + [(10**14, "b\tc\n" * 40), (1, docs[5][1]), (2, None), (3, ""), (4, "X" + docs[7][1]), (5, docs[7][1].upper())]
    docs += [(10**14 + 1, " ".join(word(3000, 3)))]
    docs = list({d: t for d, t in docs}.items())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(9), hot).collect()}
    assert got == brute.passages(docs)


def test_passages_spans(spark):
    w = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(w)), (2, "x " + " ".join(w[:25]) + " y"), (3, " ".join(w))], "doc_id long, text string")
    assert {r.doc_id: list(r.spans) for r in remove_passages(docs).collect()} == {1: [], 2: [1, 26], 3: [0, 40]}


def test_passages_null_and_repeated_ids(spark):
    w, v = " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(30))
    docs = spark.createDataFrame([(None, w), (4, w), (4, w), (5, v), (5, w), (None, v), (6, v + " end")], "doc_id long, text string").withColumn("block", F.lit(0)).withColumn("sub", F.lit(0))
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in remove_passages(docs).collect()), key=str)
    assert got == sorted([(None, 30, 0), (None, 30, 0), (4, 30, 0), (4, 30, 0), (5, 30, 0), (5, 30, 30), (6, 31, 30)], key=str)


def test_passages_without_repeats(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(200))) for i in range(8)], "doc_id long, text string").repartition(4)
    assert {r.n_removed for r in remove_passages(docs).collect()} == {0}


def test_passages_empty_table(spark):
    assert remove_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []
