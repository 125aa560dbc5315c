"""Expressions on known tokens, invariants of graphs and matchings, and sequential operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelgraph.functions import rules as R
from labelgraph.operators import associate as A
from labelgraph.operators import classify as C
from labelgraph.operators import correct as K
from labelgraph.operators import enrich as E
from labelgraph.operators import evaluate as V
from labelgraph.operators import extract as X
from labelgraph.operators import graph as G
from labelgraph.operators import match as M
from labelgraph.operators import model_text as T
from labelgraph.sources import files

TOKEN = "image_id long, tok_idx long, ln long, wn long, token string, x1 long, y1 long, x2 long, y2 long, cx double, cy double, conf double"


def rows(spark, texts, image=1, pitch=40):
    out = []
    for i, line in enumerate(texts):
        for j, t in enumerate(line):
            x1, y1 = 100 * j, pitch * i
            out.append((image, 10 * i + j, i, j, t, x1, y1, x1 + 60, y1 + 20, x1 + 30.0, y1 + 10.0, 0.9))
    return spark.createDataFrame(out, TOKEN)


LABEL = [["", "je 100 g", "pro Portion"], ["Energie", "1625 kJ", "400 kJ"], ["Fett", "0,8", "g"], ["davon Zucker", "5", "g"], ["Zutaten", "x", "abc"]]


def test_rewrite_and_split(spark):
    t = rows(spark, [["|Fett|", "1,5", "m9", "Je 100 g ca", "100g", "12mg", "1625 kJ/383kcal", "1696/404", "ENERGIEkJ/kcal", "0,44mg(88%)", "|"]])
    got = {r["original"]: r["token"] for r in K.rewrite(t).collect()}
    assert got["|Fett|"] == "Fett" and got["1,5"] == "1.5" and got["m9"] == "mg" and got["Je 100 g ca"] == "je 100g" and "|" not in got
    parts = K.split(t).orderBy("tok_idx", "part").groupBy("tok_idx").agg(F.collect_list("token").alias("p")).collect()
    by = {r["tok_idx"]: r["p"] for r in parts}
    assert by[4] == ["100g"] and by[5] == ["12", "mg"] and by[6] == ["1625", "kJ", "383", "kcal"] and by[7] == ["1696", "404"] and by[8] == ["ENERGIE", "kJ/kcal"]


def test_classify(spark):
    got = {r["token"]: r["label"] for r in C.classify(rows(spark, [["je 100 g", "g", "12 %", "5,5", "Fett", "Fett/fat", "Zutaten", "zzzz", "mg", "Vitamin C"]])).collect()}
    assert got == {"je 100 g": "CONTEXT", "g": "UNIT", "12 %": "NOISE", "5,5": "QUANTITY", "Fett": "NUTRIENT", "Fett/fat": "NUTRIENT", "Zutaten": "NOISE", "zzzz": "UNKNOWN", "mg": "UNIT", "Vitamin C": "NUTRIENT"}


def test_pipeline_and_order(spark):
    def run(df):
        n = G.nodes(E.enrich(C.classify(df)))
        e = G.edges(n)
        return n, e, sorted(map(tuple, A.tuples(n, e).collect()), key=str)

    n, e, got = run(rows(spark, LABEL))
    assert ("davon Zucker", "5", "g") in {(r[2], r[3], r[4]) for r in got}
    pairs = {(r["src"], r["dst"], r["type"]) for r in e.collect()}
    for s, d, k in pairs:
        if k in ("ROW_COMPAT", "COL_COMPAT", "DIRECTIONAL_ADJ"):
            assert (d, s, k) in pairs
        if k == "DIRECTIONAL_ADJ":
            assert (s, d, "ROW_COMPAT") not in pairs and (s, d, "COL_COMPAT") not in pairs
    assert run(rows(spark, LABEL).orderBy(F.rand(3)).repartition(8))[2] == got


def test_serialize_offsets(spark):
    t = rows(spark, LABEL[1:])
    text = E.texts(t).first()["text"]
    for r in E.serialize(t).collect():
        assert text[r["start"] : r["end"]] == r["token"]


def test_matching_is_one_to_one(spark):
    pairs = spark.createDataFrame([(1, g, p, float((g * p) % 3)) for g in range(6) for p in range(5)], "image_id long, g long, p long, score double")
    got = M.greedy(pairs).collect()
    assert len({r["g"] for r in got}) == len({r["p"] for r in got}) == len(got) == 5


def test_suppression_keeps_apart_boxes(spark):
    b = spark.createDataFrame([(1, 1, 0.9, 0, 0, 10, 10), (1, 2, 0.8, 2, 0, 12, 10), (1, 3, 0.7, 5, 0, 15, 10)], "image_id long, tok_idx long, conf double, x1 long, y1 long, x2 long, y2 long")
    assert sorted(r["tok_idx"] for r in M.suppress(b).collect()) == [1, 3]


def test_nutrient_match_is_never_false(spark):
    df = spark.createDataFrame([("Eiweiß", "eiweiss"), ("Vitamin-C", "vitamin c"), ("Fett", "Salz"), ("Kohlenhydrate", "Kohlenhydrat")], "a string, b string")
    assert [r[0] for r in df.select(V.nutrient_match(F.col("a"), F.col("b"))).collect()] == [True, True, None, True]


def test_cut_off_reply(spark):
    df = spark.createDataFrame([(1, '```json\n[{"nutrient":"Fett","quantity":"1","unit":"g","context":"je 100 g"},{"nutrient":"Sal'), (2, "none"), (3, '[{"nutrient":"A{b","quantity":"2",},]')], "image_id long, reply string")
    got = {r["image_id"]: (r["parse_mode"], r["nutrient"]) for r in T.parse(df).collect()}
    assert got == {1: ("salvaged", "Fett"), 2: ("fail", None), 3: ("full", "A{b")}


def test_lines_and_rows(spark):
    t = rows(spark, LABEL[1:])
    assert E.lines(t).select("line_id").distinct().count() == 4
    assert C.row_contexts(t).select("row").distinct().count() == 4


def test_text_extraction(spark):
    df = spark.createDataFrame([(1, "pro 100 g: Fett 5,5 g Zucker 3 g. Enthält 5 mg Zink."), (2, "")], "image_id long, text string")
    p = {(r["nutrient"], r["quantity"], r["unit"], r["context"]) for r in X.paragraphs(df).collect()}
    assert ("Fett", "5.5", "g", "per_100g") in p
    assert [tuple(r) for r in X.sentences(df).collect()] == [(1, "Zink", "5", "mg")]


def test_find_entities(spark):
    t = rows(spark, [["Vitamin", "C", "5", "mg"]])
    e = spark.createDataFrame([(1, 0, "vitamin c", "NUTRIENT"), (1, 1, "mg", "UNIT")], "image_id long, entity_idx long, text string, kind string")
    assert {(r["tok_idx"], r["kind"]) for r in C.find_entities(t, e).collect()} == {(0, "NUTRIENT"), (1, "NUTRIENT"), (3, "UNIT")}


def test_files(spark, tmp_path):
    gold = spark.createDataFrame([("1.png", "Fett", "1", "g", "per 100g", None, None), ("2.png", "Salz", "2", "g", None, None, "30 g")], "image_id string, nutrient string, quantity string, unit string, context string, nrv_percent string, serving_size string")
    (tmp_path / "gold").mkdir()
    for r in files.nest(gold).toJSON().collect():  # one document a file
        (tmp_path / "gold" / f"{abs(hash(r))}.json").write_text(r)
    back = files.read_gold_json(spark, str(tmp_path / "gold"))
    assert {(r["image_id"], r["nutrient"], r["context"]) for r in back.collect()} == {("1.png", "Fett", "per 100g"), ("2.png", "Salz", " (30 g)")}
    files.write_csv(gold.withColumnRenamed("nutrient", "Name"), str(tmp_path / "csv"))
    assert files.read_gold_csv(spark, str(tmp_path / "csv"), {"nutrient": ["name"]}).where("nutrient = 'Fett'").count() == 1


def test_fold(spark):
    assert spark.createDataFrame([("Öl ß",)], "t string").select(R.fold_letters(F.col("t"))).first()[0] == "ol ss"


def test_fallback_chain_of_tuples(spark):
    """Column quantities on either side, tight before wide; then the dosage stream's rank; units of the name's row; a bare name keeps its context."""
    def node(i, label, token, cx, cy, ctx=None, nr=-1, qr=-1, stream=-1):
        return (1, i, label, token, token.lower(), float(cx), float(cy), cx - 5, cy - 10, cx + 5, cy + 10, ctx, nr, qr, stream, 0.9)

    rows = [
        node(0, "NUTRIENT", "Fett", 10, 10),
        node(1, "QUANTITY", "5", 5, 40),
        node(2, "QUANTITY", "6", 10, 50),
        node(3, "QUANTITY", "7", 10, 120),
        node(4, "NUTRIENT", "Salz", 300, 400, nr=2),
        node(5, "QUANTITY", "9", 500, 700, qr=2, stream=0),
        node(6, "UNIT", "g", 60, 10),
        node(7, "NUTRIENT", "Zink", 300, 500, ctx="per_100g"),
    ]
    n = spark.createDataFrame(rows, "image_id long, id long, label string, token string, norm string, cx double, cy double, x1 long, y1 long, x2 long, y2 long, column_context_id string, nutrient_rank_in_column long, qty_rank_in_column long, dosage_stream_id long, conf double")
    for version, (row, col, _) in G.NAMES.items():
        e = spark.createDataFrame([(1, 0, 1, col, 1.0), (1, 0, 2, col, 1.0), (1, 0, 3, col, 1.0), (1, 0, 6, row, 1.0)], "image_id long, src long, dst long, type string, weight double")
        got = [tuple(r)[2:] for r in A.tuples(n, e, version).drop("nrv_percent", "serving_size").orderBy("ord").collect()]
        assert got == [("Fett", "5", "g", None), ("Fett", "6", "g", None), ("Salz", "9", None, None), ("Zink", None, None, "per_100g")]
