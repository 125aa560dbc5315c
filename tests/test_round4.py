"""Guards and shared steps of the token rules: same results, each evaluated once."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from labelgraph.functions import label_tables as L
from labelgraph.functions import rules as R
from labelgraph.operators import correct as K


def test_any_of_finds_what_the_words_find():
    for words in (L.NOISE, L.CONTEXT_PARTS, L.NAMES):
        found = re.compile(R.any_of(words))
        for text in [*words, *(f"x{w}y" for w in words), *(w[:-1] for w in words), "", "the"]:
            assert bool(found.search(text)) == any(w in text for w in words), text


def test_columns_made_once_are_not_repeated_by_a_filter(spark):
    rows = R.once(spark.range(3).select(F.col("id").cast("string").alias("t")), u=F.regexp_replace("t", "1", "one")).where("u <> '2'")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1 and sorted(r.u for r in rows.collect()) == ["0", "one"]


def test_rewrite_of_distinct_tokens_counts_all(spark):
    t = spark.createDataFrame([("Magneslum",), ("Magneslum",), ("1,5",), ("der",)], "token string")
    assert {(r.token, r.n, tuple(r.rules_fired)) for r in K.rewrite_counts(t).collect()} == {("Magnesium", 2, ("targeted_11",)), ("1.5", 1, ("decimal",)), ("der", 1, ())}
    assert {r.rule: r.n for r in K.report(K.rewrite_counts(t)).collect()} == {"targeted_11": 2, "decimal": 1}
