"""Literal cases of tuple association, names, labels from two sources, late verdicts, regions, numbering, ranks and corners."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from labelgraph.functions import rules as R
from labelgraph.operators import associate as A
from labelgraph.operators import classify as C
from labelgraph.operators import correct as K
from labelgraph.operators import enrich as E
from labelgraph.operators import evaluate as V
from labelgraph.operators import extract as X
from labelgraph.operators import graph as G
from labelgraph.operators import hybrid as H
from labelgraph.operators import match as M
from labelgraph.operators import names as N
from labelgraph.operators import profile as P
from labelgraph.operators import regions as W
from labelgraph.plans import pipeline
from labelgraph.sources import models
from labelgraph.sources.adapters import tokens

SF = "/root/testdata/sf0.001"
NODE = "image_id long, id long, label string, token string, norm string, cx double, cy double, x1 long, y1 long, x2 long, y2 long, column_context_id string, nutrient_rank_in_column long, qty_rank_in_column long, dosage_stream_id long, conf double, scale double, is_header boolean, column_id long, column_role string"


def node(i, label, token, cx, cy, ctx=None, nr=-1, qr=-1, stream=-1, image=1, column=0, role=None):
    return (image, i, label, token, token.lower(), float(cx), float(cy), cx - 5, cy - 10, cx + 5, cy + 10, ctx, nr, qr, stream, 0.9, 1.0, False, column, role)


def found(spark, rows, version=2):
    out = A.tuples(spark.createDataFrame(rows, NODE), version=version).orderBy("image_id", "ord").collect()
    return [tuple(r)[2:] for r in out]


def test_energy_names_search_farther(spark):
    rows = [node(0, "NUTRIENT", "Energie", 10, 100), node(1, "QUANTITY", "0,8", 200, 105), node(2, "UNIT", "g", 230, 105), node(3, "QUANTITY", "1625kj", 200, 150), node(4, "QUANTITY", "383", 260, 160), node(5, "UNIT", "kcal", 290, 160), node(6, "QUANTITY", "999kj", 200, 300)]
    got = found(spark, rows)
    # Both lie within 4 heights, the third does not; from left to right.
    assert [r[:3] for r in got] == [("Energie", "1625", "kj"), ("Energie", "383", "kcal")]
    near = [*rows, node(7, "QUANTITY", "50kcal", 300, 100)]
    assert [r[:3] for r in found(spark, near)] == [("Energie", "50", "kcal")]
    alone = rows[:3]
    assert [r[:3] for r in found(spark, alone)] == [("Energie", "0.8", "g")]


def test_unit_at_the_end_of_a_name(spark):
    texts = {"Zink (mg)": "mg", "Energie kJ/kcal": "kj/kcal", "Niacin (mg NE):": "mg ne", "Eisen / g ": "g", "Vitamin C": None, "Magnesium": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.u for r in df.select("t", A.embedded_unit(F.col("t")).alias("u")).collect()} == texts
    assert found(spark, [node(0, "NUTRIENT", "Zink (mg)", 10, 100), node(1, "QUANTITY", "5", 200, 100)])[0][:3] == ("Zink (mg)", "5", "mg")


def test_stream_and_row_mode_by_image(spark):
    bare = lambda image, stream: [node(0, "NUTRIENT", "Zink", 10, 400, ctx="column", image=image), node(1, "CONTEXT", "graph", 12, 300, image=image, column=1), node(2, "QUANTITY", "5", 900, 900, stream=stream, qr=7, image=image, column=2)]
    assert [r[3] for r in found(spark, bare(1, 0) + bare(2, -1))] == ["column", "graph"]
    # The rank fallback belongs to stream mode.
    ranked = [node(0, "NUTRIENT", "Zink", 10, 400, nr=7), node(1, "QUANTITY", "5", 900, 900, stream=0, qr=7, column=2)]
    assert found(spark, ranked)[0][1] == found(spark, ranked, version=1)[0][1] == "5"


def test_percentages_and_servings(spark):
    rows = [node(0, "NUTRIENT", "Zink", 10, 100), node(1, "QUANTITY", "5", 200, 100), node(2, "NRV", "12,5 %", 300, 104), node(3, "NUTRIENT", "Eisen", 10, 200), node(4, "QUANTITY", "7 (30 %)", 200, 200), node(5, "NUTRIENT", "Salz", 10, 900), node(6, "SERVING", "2 Kapseln", 10, 990), node(7, "SERVING", "9 Drops", 10, 995)]
    assert [(r[0], r[4], r[5]) for r in found(spark, rows)] == [("Zink", "12.5", "2 Kapseln"), ("Eisen", "30", "2 Kapseln"), ("Salz", None, "2 Kapseln")]


def test_reference_marks(spark):
    t = spark.createDataFrame([(1, i, x, 0.9) for i, x in enumerate(["12 %", "3 Gummies", "2 Kapseln", "Zutaten", "g", "5"])] + [(1, 9, "15 %", 0.1)], "image_id long, tok_idx long, token string, conf double")
    assert {r.token: (r.label, r.reference) for r in C.classify(t).collect()} == {"12 %": ("NOISE", "NRV"), "3 Gummies": ("NOISE", "SERVING"), "2 Kapseln": ("CONTEXT", None), "Zutaten": ("NOISE", None), "g": ("UNIT", None), "5": ("QUANTITY", None), "15 %": ("NOISE", None)}


def test_edges_and_geometry_give_the_same_tuples(spark):
    t = C.classify(tokens(spark, SF).where("image_id % 13 = 0"))
    n = G.nodes(E.enrich(t))
    for version in (1, 2):
        kept = n if version == 2 else G.nodes(E.enrich(t), 1)
        mine = A.tuples(kept, version=version).drop("nrv_percent", "serving_size")
        theirs = A.tuples(kept, G.edges(kept, version), version).drop("nrv_percent", "serving_size")
        assert mine.count() > 100 and mine.exceptAll(theirs).count() == 0 and theirs.exceptAll(mine).count() == 0


def test_tuples_shuffle_once_by_image(spark):
    plan = pipeline.tuples(tokens(spark, SF))._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Exchange") <= 2 and "Join" not in plan and "SinglePartition" not in plan


CONTEXTS = {
    "per 100g": "per_100g", "(Je 100 g)*": "per_100g", "Typical values per piece": "per_serving", "2 kapseln": "per_daily_dose", "ration 1ampulle": "per_daily_dose", "Pro Riegel": "per_serving", "pro Löffel": "per_serving",
    "je 30 g": "je 30 g", "pr.4g": "per_serving", "pro100ml": "per_100ml", "par/na 5": "per_100g", "Empfohlene Tagesdosis": "empfohlene tagesdosis", "Fett": None, "5 g": None, "per day": None,
}


def test_contexts(spark):
    df = spark.createDataFrame([(k,) for k in CONTEXTS], "t string")
    assert {r.t: r.c for r in df.select("t", R.context(R.normal(F.col("t")), F.col("t")).alias("c")).collect()} == CONTEXTS


GOLD_NAMES = {
    "Energie": ("Energy", "exact"),
    " Energie ": ("Energy", "exact"),
    "- davon Zucker": ("Sugars", "exact"),
    "• Fett:": ("Fat", "cleaned"),
    "Brennwert ...... Energie": ("Energy", "segment"),
    "Eiweiß / Protein / Proteine": ("Protein", "segment"),
    "Zout/ Sel": ("Salt", "segment"),
    "kohlenhydrate/carbohydrate": ("Carbohydrate", "segment"),
    "fett": ("Fat", "lower"),
    "Vitamin E**": ("Vitamin E", "starred"),
    "magnesium*": ("Magnesium", "starred"),
    "Koffein (aus Guarana)": ("Caffeine", "pattern"),
    "Vitamin A (RE)": ("Vitamin A", "pattern"),
    "Unbekannt  (x):": ("Unbekannt (x)", "text"),
    None: (None, None),
}


def test_gold_names(spark):
    df = spark.createDataFrame([(k,) for k in GOLD_NAMES] * 2, "name string")
    out = N.resolve(df, "name")
    assert out.count() == 2 * len(GOLD_NAMES)
    assert {r.name: (r.canonical, r.stage) for r in out.collect()} == GOLD_NAMES


MODEL_NAMES = {
    "Brennwert (kJ)": "Energy", "davon gesättigte Fettsäuren": "Saturated Fats", "Fruktose": "Fructose", "- davon Zucker": "Sugars", "Kohlenhydrate": "Carbohydrate", "Fett / Fat": "Fat", "Eiweiß": "Protein", "dietary fiber": "Fibre", "Sel": "Salt",
    "B 6": "Vitamin B6", "B12 (Cobalamin)": "Vitamin B12", "Vitamin A (aus Provitamin A)": "Vitamin A", "vitamin d3": "Vitamin D3", "Thiamin": "Vitamin B1", "Folsäure": "Folic Acid", "Pantothensäure": "Pantothenic Acid", "Alpha-Liponsäure": "Alpha-Liponsäure",
    "Kreatin": "Creatine", "L-Isoleucine": "L-Leucine", "Grüntee (Extrakt)": "Grüntee", "(nur)": "(nur)", " - * ": "", None: "",
}


def test_model_names(spark):
    got = {r.name: r.canonical for r in N.canonicalize(spark.createDataFrame([(k,) for k in MODEL_NAMES], "name string"), "name").collect()}
    assert got == MODEL_NAMES


def test_labels_from_two_sources(spark):
    t = spark.createDataFrame([(1, 0, "Fet", "UNKNOWN", "Fet 5 g"), (1, 1, "5", "QUANTITY", "Fet 5 g"), (1, 2, "xyz", "UNKNOWN", "xyz"), (1, 3, "Salz", "NUTRIENT", "Salz 1"), (1, 4, "qq", "UNKNOWN", "qq")], "image_id long, tok_idx long, token string, label string, context string")
    vectors = spark.createDataFrame([("Fet 5 g", [1.0, 0.1]), ("xyz", [0.8, 0.78]), ("Salz 1", [0.0, 1.0])], "text string, embedding array<double>")
    protos = spark.createDataFrame([("NUTRIENT", [1.0, 0.0]), ("UNIT", [0.0, 1.0]), ("NOISE", [0.1, 1.0])], "category string, vec array<double>")
    got = {r.tok_idx: (r.label, r.method, r.other_category) for r in H.hybrid(t, vectors, protos).collect()}
    assert got == {0: ("NUTRIENT", "embedding", "NOISE"), 1: ("QUANTITY", "rule", None), 2: ("UNKNOWN", "embedding", "NOISE"), 3: ("NUTRIENT", "rule", None), 4: ("UNKNOWN", "embedding", None)}
    assert {r.tok_idx: r.label for r in H.hybrid(t, vectors, protos, "embedding_only").collect()}[3] == "UNKNOWN"
    with pytest.raises(ValueError):
        C.category_scores(vectors, protos.crossJoin(spark.range(5000)).drop("id"), "text")


def test_row_texts(spark):
    t = spark.createDataFrame([(1, i, f"t{i}", float(-i)) for i in range(12)] + [(1, 20, "b", 2.0), (1, 21, "a", 1.0)], "image_id long, tok_idx long, token string, cx double")
    rows = t.select("image_id", "tok_idx", F.when(F.col("tok_idx") < 12, 0).otherwise(1).alias("row"))
    got = {r.tok_idx: r.context for r in H.row_texts(t, rows).collect()}
    assert got[20] == got[21] == "a b" and got[5] == "t8 t7 t6 t5 t4 t3 t2" and got[11] == "t11 t10 t9 t8" and got[0] == "t3 t2 t1 t0"


def test_relabelling(spark):
    gold = spark.createDataFrame([(1, "davon Gesättigte Fettsäuren"), (1, "Magnesium")], "image_id long, nutrient string")
    assert sorted(H.gold_words(gold).first().words) == ["fettsauren", "gesattigte", "magnesium"]
    dump = spark.createDataFrame([(1, "Magnesi", 1), (1, "davon", 0), (1, "x/Magnesium:5", 0), (1, "Fett", 0), (2, "Magnesium", 0), (1, "gesättigte Z", 1)], "image_id long, token string, gt_label int")
    got = {(r.image_id, r.token): r.gt_label for r in H.relabel(dump, gold).collect()}
    assert got == {(1, "Magnesi"): 1, (1, "davon"): 0, (1, "x/Magnesium:5"): 1, (1, "Fett"): 0, (2, "Magnesium"): 0, (1, "gesättigte Z"): 1}
    assert {(r.was, r.now): r.n for r in H.flips(H.relabel(dump, gold)).collect()} == {(1, 1): 2, (0, 0): 3, (0, 1): 1}


def test_late_verdicts(spark):
    fast = spark.createDataFrame([(1, 1, 1, True, True, True, True), (1, 1, 2, None, False, True, True), (1, 1, 3, None, True, True, True), (1, 2, 1, True, False, True, True)], "image_id long, g long, p long, name boolean, qty_ok boolean, unit_ok boolean, ctx_ok boolean")
    v = spark.createDataFrame([(1, 1, 2, True, True, None, False, "same", "rounded", None, None), (1, 2, 1, False, True, True, True, "no", "", "", "")], "image_id long, g long, p long, nutrient_match boolean, quantity_match boolean, unit_match boolean, context_match boolean, nutrient_reason string, quantity_reason string, unit_reason string, context_reason string")
    got = {(r.g, r.p): (r.name_ok, r.qty_ok, r.full, r.method, r.nutrient_reason, r.quantity_reason) for r in V.with_verdicts(fast, v).collect()}
    assert got == {
        (1, 1): (True, True, True, "fast", "exact/substring match", "numeric match"),
        (1, 2): (True, True, True, "fast+llm", "same", "rounded"),
        (1, 3): (False, True, False, "fast", "no match", "numeric match"),
        (2, 1): (True, False, False, "fast", "substring match", "mismatch"),  # a known name is not asked about
    }


def test_densest_window(spark):
    box = lambda image, y, x=0, h=10, w=50: (image, x, y, x + w, y + h, 100, 100)
    rows = [box(1, y) for y in (0, 50, 55, 60, 65, 70)] + [box(1, 45, h=50)] + [box(2, 0), box(2, 1), box(2, 2)] + [box(3, y, w=20) for y in (0, 1, 2, 3)]
    got = [tuple(r) for r in W.densest_window(spark.createDataFrame(rows, "image_id long, x1 long, y1 long, x2 long, y2 long, width long, height long")).collect()]
    assert got == [(1, 0, 50, 50, 80, 5)]


def test_dense_ids(spark):
    df = spark.range(5000).select(F.pmod(F.hash("id"), F.lit(7)).alias("a"), "id").withColumn("a", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("a"))).withColumnRenamed("id", "b")
    out = W.dense_ids(df, ["a", "b"], 16)
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString().split("Window")[0]
    rows = sorted((r.a, r.b, r.id) for r in out.collect())
    assert [r[2] for r in rows] == list(range(1, 5001))
    assert W.dense_ids(df.limit(0), ["a", "b"]).collect() == []


def test_rank_alignment(spark):
    rows = [node(0, "NUTRIENT", "Fett", 10, 100, nr=0, role="NUTRIENT"), node(1, "NUTRIENT", "Salz", 10, 200, nr=1, role="NUTRIENT")]
    rows += [node(2 + i, "QUANTITY", str(i), 100 + i, 100, qr=q, stream=0, column=1, role="DOSAGE") for i, q in enumerate((1, 0, 5))] + [node(9, "QUANTITY", "9", 100, 200, qr=-1, column=2, role="MIXED")]
    n = spark.createDataFrame(rows, NODE)
    gold = spark.createDataFrame([(1, 0, "Fett", "1"), (1, 1, "Salz", "2")], "image_id long, g long, nutrient string, quantity string")
    got = P.rank_alignment(n, G.edges(n), gold).first().asDict()
    assert got == {"rank_consistent": 0, "rank_inconsistent": 1, "with_rank": 2, "matched": 2, "unmatched": 0, "multi": 1, "multi_correct": 1, "multi_wrong": 0, "in_order": 0, "out_of_order": 0}


def test_corners_change_rows_and_columns(spark):
    box = lambda i, x, y, q: (1, i, x, y, x + 10, y + 10, x + 5.0, y + 5.0, q)
    slant = lambda x, y: [[float(x), float(y)], [x + 10.0, y + 10.0], [x + 0.0, y + 20.0], [x - 10.0, y + 10.0]]
    df = "image_id long, tok_idx long, x1 long, y1 long, x2 long, y2 long, cx double, cy double, quad array<array<double>>"
    pairs = [(0, 0), (100, 100)]
    level = E.compatible(spark.createDataFrame([box(i, x, y, None) for i, (x, y) in enumerate(pairs)], df)).first()
    tilted = E.compatible(spark.createDataFrame([box(i, x, y, slant(x, y)) for i, (x, y) in enumerate(pairs)], df)).first()
    assert not level.row_ok and tilted.row_ok and not tilted.col_ok
    g = E.geometry(spark.createDataFrame([box(0, 0, 0, slant(0, 0)), box(1, 0, 0, [[0.0, 0.0], [0.0, 0.0], [1.0, 1.0], [0.0, 1.0]]), box(2, 0, 0, [[0.0, 0.0]])], df)).orderBy("tok_idx").collect()
    assert [round(r.angle_deg, 6) for r in g] == [45.0, 0.0, 0.0] and g[0].nx < 0 < g[0].ny


def test_matching_keeps_what_comes_along(spark):
    pairs = spark.createDataFrame([(1, 0, 0, 2.0, "a"), (1, 0, 1, 3.0, "b"), (1, 1, 1, 2.5, "c"), (1, 1, 0, 1.0, "d")], "image_id long, g long, p long, score double, note string")
    assert sorted((r.g, r.p, r.note) for r in M.greedy(pairs).collect()) == [(0, 1, "b"), (1, 0, "d")]


def test_sentences_of_five_kinds(spark):
    texts = {
        1: "Jede Tablette enthält 25 µg Colecalciferol, entsprechend 1000 I.E. Vitamin D",
        2: "Die Tagesdosis bis zu 2,5 mcg deckt Vitamin B12",
        3: "Vitamin D3 25 ug und VITAMIN D3 25 µg",
        4: "entsprechend 5 mg",
    }
    got = {(r.image_id, r.nutrient, r.quantity, r.unit) for r in X.sentence_tuples(spark.createDataFrame(list(texts.items()), "image_id long, text string")).collect()}
    assert got == {(1, "Colecalciferol", "25", "µg"), (1, "Colecalciferol", "1000", "IE"), (1, "Vitamin", "1000", "IE"), (2, "Vitamin B12", "2.5", "µg"), (3, "Vitamin D3", "25", "µg")}


def test_corrector_tables(spark):
    first = {"Hagnesium": "Magnesium", "25 m0": "25mg", "4O5": "405", "|Salz|}": "Salz", "40µ": "40µg", "'Zink'": "Zink", "KCAI": "kcal", "12m": "12mg", "Saiz|Sait": "Salz/Salt", "fettsauren": "Fettsäuren", "Milch": "Milch"}
    df = spark.createDataFrame([(t,) for t in first], "token string")
    assert {r.token: r.c for r in df.select("token", K.first_level(F.col("token")).alias("c")).collect()} == first
    targeted = {"O406": "0406", "4O6": "406", "4l6": "416", "30 M9": "30mg", "Mcg": "µg", "Kj/kcal": "kJ/kcal", "Vltamln": "Vitamin", "Ph0sphor": "Phosphor", "Bailaststoffe": "Ballaststoffe"}
    t = spark.createDataFrame([(1, i, x) for i, x in enumerate(targeted)], "image_id long, tok_idx long, token string")
    assert {r.original: r.token for r in K.rewrite(t).collect()} == targeted


class Flaky:
    def __init__(self):
        self.calls = 0

    def __call__(self, row):
        self.calls += 1
        if row["text"] == "bad" or (row["text"] == "slow" and self.calls % 2):
            raise ValueError(row["text"])
        return [(row["id"], row["text"].upper())]


def test_failed_model_calls_are_reported(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "slow")], "id long, text string").coalesce(1)
    got = models.call(rows, "flaky", Flaky, lambda m, r: m(r), "id long, reply string").collect()
    assert sorted(map(tuple, got), key=str) == [(1, "A", None), (2, None, "ValueError: bad"), (3, "SLOW", None)]
