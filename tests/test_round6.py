"""What a token is enriched with is made from the arrays of its image, without a sort for each step."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelgraph import oracle as O
from labelgraph.operators import classify as C
from labelgraph.operators import enrich as E
from labelgraph.operators import graph as G
from labelgraph.operators import profile as P
from labelgraph.operators import regions as W
from labelgraph.queries import QUERIES
from labelgraph.sources.adapters import tokens

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_images_as_rows_have_what_enrichment_adds(spark):
    # Odd places: columns apart and together, tall images, headers in the first rows and below.
    t = tokens(spark, SF).where("image_id % 11 = 0").withColumn("token", F.expr(O.MARKED))
    t = t.withColumns({"cx": F.expr("CASE WHEN image_id % 2 = 0 AND tok_idx % 6 < 2 THEN 10 ELSE cx * (1 + tok_idx % 2) END"), "y2": F.expr("y2 + CASE WHEN image_id % 3 = 0 THEN 900 ELSE 0 END"), "cy": F.expr("CASE WHEN tok_idx % 17 = 0 THEN 3 ELSE cy END")})
    labelled = C.classify(t).cache()
    added = ["scale", "is_header", "column_id", "column_context_id", "column_role", "dosage_stream_id", "qty_rank_in_column", "nutrient_rank_in_column"]
    images = E.by_image(labelled)
    for name, label in E.LISTS.items():
        mine = images.select("image_id", F.explode(name).alias("x")).select("image_id", "x.id", "x.token", *(f"x.{c}" for c in added))
        theirs = G.nodes(E.enrich(labelled)).where(F.col("label") == label).select("image_id", "id", "token", *added)
        assert mine.count() > 100 and mine.exceptAll(theirs).count() == 0 and theirs.exceptAll(mine).count() == 0
    references = images.select(F.sum(F.size("ps")), F.sum(F.size("servings"))).first()
    assert tuple(references) == tuple(labelled.select(F.count_if(F.col("reference") == "NRV"), F.count_if(F.col("reference") == "SERVING")).first())


def test_tokens_are_not_sorted_for_each_step(spark):
    for name in ("associate_reference_values", "associate_tuples", "associate_tuples_v1"):
        assert "RepartitionByExpression" not in _plan(QUERIES[name](spark, SF)) and _plan(QUERIES[name](spark, SF)).count("Window [") <= 2


def test_densest_window_meets_by_image(spark):
    plan = _plan(QUERIES["region_densest_window"](spark, SF))
    assert "Join" not in plan and "Window [" not in plan and plan.count("Relation [") == 1
    # Against all windows: equal tops, boxes taller than a window, ends on its border.
    rows = [(i, 10 * (k % 3), y, 90 + 10 * (k % 3), y + h, 100, 100) for i in range(40) for k, (y, h) in enumerate(((i * 7 + k * k * (3 + i % 5)) % 90, (i * k) % 60) for k in range(9))]
    want = {}
    for i in range(40):
        b = [r[1:5] for r in rows if r[0] == i]
        n, top = max((sum(y <= c[1] and c[3] <= y + 40 for c in b), -y) for _, y, _, _ in b)
        inside = [c for c in b if -top <= c[1] and c[3] <= -top + 40]
        if n >= 4:
            want[i] = (min(c[0] for c in inside), min(c[1] for c in inside), max(c[2] for c in inside), max(c[3] for c in inside), n)
    df = spark.createDataFrame(rows, "image_id long, x1 long, y1 long, x2 long, y2 long, width long, height long")
    assert 5 < len(want) < 40 and {r[0]: tuple(r)[1:] for r in W.densest_window(df).collect()} == want


def test_rank_alignment_keeps_no_graph(spark):
    plan = _plan(QUERIES["profile_rank_alignment"](spark, SF))
    assert "InMemoryRelation" not in plan and plan.count("Join ") == 1 and plan.count("Relation [") == 2


def test_rank_alignment_by_image_is_that_by_edges(spark):
    # Tokens moved to other columns, so that ranks and rows differ.
    t = tokens(spark, SF).where("image_id % 13 = 0").withColumns({"cx": F.expr("cx + (tok_idx * 7 + image_id) % 3 * 60"), "cy": F.expr("cy + CASE WHEN tok_idx % 7 = 0 THEN 30 ELSE 0 END")})
    labelled = C.classify(t).cache()
    gold = t.groupBy("image_id", F.col("ln").alias("g")).agg(F.max(F.when(F.col("wn") == 0, F.col("token"))).alias("nutrient"), F.max(F.when(F.col("wn") == 1, F.col("token"))).alias("quantity"))
    n = G.nodes(E.enrich(labelled)).cache()
    mine, theirs = P.rank_alignment_of_images(E.by_image(labelled), gold).first().asDict(), P.rank_alignment(n, G.edges(n), gold).first().asDict()
    assert mine == theirs and mine["with_rank"] > 100
