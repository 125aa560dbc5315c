"""Steps made once a row, not once a pair; pairs made once a query."""

from __future__ import annotations

import re

import pytest

from labelgraph.operators import associate as A
from labelgraph.operators import classify as C
from labelgraph.operators import enrich as E
from labelgraph.operators import evaluate as V
from labelgraph.operators import graph as G
from labelgraph.queries import QUERIES
from labelgraph.sources.adapters import tokens

SF = "/root/testdata/sf0.001"

TUPLE = "image_id long, {} long, nutrient string, quantity string, unit string, context string"


def _tables(spark):
    gold = spark.createDataFrame([(1, 1, "Fett / fat", "1,50", "μg", "je (x) 100 g"), (1, 2, "Salz", None, "IE", None), (1, 3, "", "x", None, "a")], TUPLE.format("g"))
    pred = spark.createDataFrame([(1, 1, "fat", "1.5", "µg", "JE 100 G"), (1, 2, "sa-lz", "", "iu", None), (1, 9, "Zink", "7", "g", None)], TUPLE.format("p"))
    return gold, pred


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_normalised_before_pairs_are_made(spark):
    plan = _plan(V.candidates(*_tables(spark)))
    above = plan[: plan.index("Join Inner")]
    assert not re.search("regexp_replace|translate|lower|RLIKE|try_cast", above)


def test_pairs_of_odd_tuples(spark):
    rows = {(r.g, r.p): (r.name_ok, r.qty_ok, r.unit_ok, r.ctx_ok) for r in V.candidates(*_tables(spark)).collect()}
    assert rows[1, 1] == (True, True, True, True) and rows[2, 2] == (True, True, True, True) and rows[3, 9] == (False, False, False, False) and rows[3, 2] == (False, False, False, False)


def test_diff_and_verdicts_make_the_pairs_once(spark):
    gold, pred = _tables(spark)
    diff = V.diff(gold, pred, V.match(gold, pred))
    assert _plan(diff).count("Join Inner") == 1
    assert sorted((r.g, r.p, r.match) for r in diff.collect() if r.g and r.p) == [(1, 1, "Full 4f"), (2, 2, "Full 4f")]
    assert sorted((r.g or 0, r.p or 0, r.match) for r in diff.collect() if not (r.g and r.p)) == [(0, 9, "Pred only"), (3, 0, "GT only")]
    asked = spark.createDataFrame([(1, 2, 2, False, False, False, False, "late", None, None, None), (1, 3, 9, True, None, True, False, "same", None, "u", None)], "image_id long, g long, p long, nutrient_match boolean, quantity_match boolean, unit_match boolean, context_match boolean, nutrient_reason string, quantity_reason string, unit_reason string, context_reason string")
    late = V.with_verdicts(V.fast_fields(gold, pred), asked)
    assert _plan(late).count("Join Inner") == 1
    rows = {(r.g, r.p): (r.name_ok, r.qty_ok, r.unit_ok, r.method, r.nutrient_reason, r.unit_reason) for r in late.collect()}
    assert len(rows) == 9 and rows[3, 9] == (True, False, True, "fast+llm", "same", "u") and rows[2, 2][3:5] == ("fast", "exact/substring match") and rows[3, 1] == (False, False, False, "fast", "no match", "mismatch")


@pytest.mark.parametrize("name", ["graph_edges_v1", "graph_node_counts", "associate_contexts", "associate_smallest_context", "associate_leftmost_quantities", "associate_column_fallback", "associate_match_scores"])
def test_nodes_of_an_image_are_made_once_and_not_kept(spark, name):
    plan = _plan(QUERIES[name](spark, SF))
    assert "Join" not in plan and "InMemoryRelation" not in plan and plan.count("Relation [") == 1


def test_neighbours_by_geometry_are_those_by_edges(spark):
    # Names moved down by some lines have quantities in their column only.
    t = C.classify(tokens(spark, SF).where("image_id % 13 = 0")).withColumns({"cy": A.F.expr("cy + CASE WHEN label = 'NUTRIENT' AND tok_idx % 4 = 0 THEN 3000 ELSE 0 END"), "cx": A.F.expr("CASE WHEN image_id % 2 = 0 AND tok_idx % 6 < 2 THEN 10 ELSE cx END")})
    n = G.nodes(E.enrich(t)).cache()
    e = G.edges(n).cache()
    for f in (A.contexts, A.smallest_context, A.match_scores, A.quantities):
        mine, theirs = f(n), f(n, e)
        assert mine.count() and mine.exceptAll(theirs).count() == 0 and theirs.exceptAll(mine).count() == 0
    mine, theirs = A.column_fallback(n), A.column_fallback(n, e, A.quantities(n, e))
    assert mine.exceptAll(theirs).count() == 0 and theirs.exceptAll(mine).count() == 0


def test_totals_of_compatible_pairs(spark):
    t = spark.createDataFrame([(1, 1, 0, 0, 10, 10, 5.0, 5.0), (1, 2, 100, 5, 110, 15, 105.0, 10.0), (1, 3, 0, 90, 10, 100, 5.0, 95.0), (2, 1, 0, 0, 1, 1, 0.5, 0.5)], "image_id long, tok_idx long, x1 long, y1 long, x2 long, y2 long, cx double, cy double")
    totals = E.compatible_totals(t)
    assert [tuple(r) for r in totals.collect()] == [(1, 1, 1, 8000, 10000)] and "Join" not in _plan(totals)


def test_image_diagnostics_keep_no_edges(spark):
    assert "InMemoryRelation" not in _plan(QUERIES["profile_image_diagnostics"](spark, SF))
