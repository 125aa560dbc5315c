"""Predicted tuples against gold ones: predicates, matching, pair details and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from .match import greedy

FIELDS = ("nutrient", "quantity", "unit", "context")


def norm_quantity(c: Column) -> Column:
    """Number as text: no decimals where whole, else up to ten digits; other text trimmed, lower-cased."""
    t = _plain_quantity(c)
    return _quantity_text(t, _number(t))


def _plain_quantity(c: Column) -> Column:
    return F.replace(F.trim(F.lower(c)), F.lit(","), F.lit("."))


def _number(c: Column) -> Column:
    return F.when(c.rlike(r"^[+-]?[0-9]+(\.[0-9]*)?$"), c.try_cast("double"))


def _quantity_text(t: Column, number: Column) -> Column:
    return F.when(number == F.floor(number), number.cast("long").cast("string")).otherwise(F.coalesce(number.cast("string"), t))


def norm_unit(c: Column) -> Column:
    t = F.replace(F.trim(F.lower(c)), F.lit("μ"), F.lit("µ"))
    table = F.create_map(*(F.lit(x) for pair in R.UNIT_ALIASES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, t), t)


def norm_context(c: Column) -> Column:
    low = F.lower(c)
    # Most contexts have neither brackets nor blanks to replace.
    bare = F.trim(F.when(F.contains(low, F.lit("(")), F.regexp_replace(low, r"\s*\([^)]*\)", "")).otherwise(low))
    return F.when(bare.rlike(r"\s"), F.regexp_replace(bare, r"\s+", "_")).otherwise(bare)


def _name_match(x: Column, y: Column, bare_x: Column, bare_y: Column) -> Column:
    ratio = F.least(F.length(x), F.length(y)) / F.greatest(F.length(x), F.length(y), F.lit(1))
    inside = (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x)) & (ratio >= 0.65)
    return F.when((x == y) | (bare_x == bare_y) | inside, F.lit(True))


def _bare(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("-"), F.lit("")), F.lit(" "), F.lit(""))


def nutrient_match(a: Column, b: Column) -> Column:
    """True if equal, equal folded, equal without dashes, or one holds the other at 0.65 of its length; else null, never false."""
    x, y = R.fold_letters(F.trim(a)), R.fold_letters(F.trim(b))
    return _name_match(x, y, _bare(x), _bare(y))


def quantity_match(a: Column, b: Column) -> Column:
    """Numbers within 1e-9, else equal text."""
    x, y = norm_quantity(a), norm_quantity(b)
    return F.coalesce(F.abs(_number(x) - _number(y)) < 1e-9, F.coalesce(x, F.lit("")) == F.coalesce(y, F.lit("")))


def _segments(folded: Column) -> Column:
    several = F.array_remove(F.transform(F.split(folded, "[/|]"), lambda x: F.trim(x)), "")
    return F.when(folded.rlike("[/|]"), several).otherwise(F.array_remove(F.array(F.trim(folded)), ""))


def any_segment(a: Column, b: Column) -> Column:
    """Does a segment of one name (between / or |) equal one of the other?"""
    return F.arrays_overlap(_segments(R.fold_letters(a)), _segments(R.fold_letters(b)))


def _normal(tuples: DataFrame, key: str) -> DataFrame:
    """(image_id, key, name, bare, parts, number, quantity, unit, context) of the tuples: what pairs compare, made once a tuple and not once a pair."""
    t = R.once(tuples, _name=R.fold_letters(F.trim("nutrient")), _text=_plain_quantity(F.col("quantity")))
    t = R.once(t, _number=_number(F.col("_text")))
    t = R.once(t, _quantity=_quantity_text(F.col("_text"), F.col("_number")))
    fields = {"name": F.col("_name"), "bare": _bare(F.col("_name")), "parts": _segments(F.col("_name")), "number": _number(F.col("_quantity")), "quantity": F.coalesce("_quantity", F.lit("")), "no_unit": F.col("unit").isNull(), "no_context": F.col("context").isNull(), "unit": norm_unit(F.col("unit")), "context": norm_context(F.col("context"))}
    return R.once(t, **fields).select("image_id", key, "nutrient", *fields)


def _compared(gold: DataFrame, pred: DataFrame) -> DataFrame:
    pairs = _normal(gold, "g").alias("g").join(_normal(pred, "p").alias("p"), "image_id")
    g, p = lambda f: F.col(f"g.{f}"), lambda f: F.col(f"p.{f}")
    same = lambda f: F.coalesce(g(f) == p(f), g(f"no_{f}") & p(f"no_{f}"))
    qty = F.coalesce(F.abs(g("number") - p("number")) < 1e-9, g("quantity") == p("quantity"))
    return pairs.select(
        "image_id", "g.g", "p.p", g("nutrient").alias("_gn"), p("nutrient").alias("_pn"), g("parts").alias("_gs"), p("parts").alias("_ps"),
        _name_match(g("name"), p("name"), g("bare"), p("bare")).alias("name"), qty.alias("qty_ok"), same("unit").alias("unit_ok"), same("context").alias("ctx_ok"),
    )


def fast_fields(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(image_id, g, p, name, qty_ok, unit_ok, ctx_ok) of all pairs of an image's gold and predicted tuples; ``name`` is true or unknown, never false."""
    return _compared(gold, pred).drop("_gs", "_ps")


def candidates(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """All pairs of an image's gold (g) and predicted (p) tuples with their field matches and score."""
    c = _compared(gold, pred)
    name = F.coalesce(F.col("name") | F.when(F.arrays_overlap("_gs", "_ps"), F.lit(True)), F.lit(False))
    # The filters and the score after this read the answers as columns.
    out = R.once(c.select("image_id", "g", "p", "name", "_gs", "_ps", "qty_ok", "unit_ok", "ctx_ok"), name_ok=name).select("image_id", "g", "p", "name_ok", "qty_ok", "unit_ok", "ctx_ok")
    score = 2 * F.col("name_ok").cast("double") + F.col("qty_ok").cast("double") + 0.5 * F.col("unit_ok").cast("double")
    return out.withColumn("score", score)


def with_verdicts(fast: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(image_id, g, p, name_ok, qty_ok, unit_ok, ctx_ok, full, method, *_reason): fast answers, with a model's late verdict where the fast one on the name is unknown.

    ``verdicts`` (image_id, g, p, nutrient_match, quantity_match, unit_match, context_match, nutrient_reason, ...)
    are asked for pairs with an unknown name only. There the name is the verdict's, and another field is right
    if either says so; a verdict's null counts as no. Without a verdict an unknown name is wrong.
    """
    fields = {"qty": "quantity", "unit": "unit", "ctx": "context"}
    keys = ["image_id", "g", "p"]
    asked = verdicts.withColumn("_asked", F.lit(True))
    # One pass over the pairs: those with a known name meet no verdict.
    rows = fast.select(*keys, "name", "qty_ok", "unit_ok", "ctx_ok").withColumn("_open", F.col("name").isNull())
    rows = rows.join(asked.withColumn("_open", F.lit(True)), [*keys, "_open"], "left")
    said = F.coalesce(F.col("_asked"), F.lit(False))
    yes = lambda c: F.coalesce(F.col(f"{c}_match"), F.lit(False))
    rows = rows.select(
        *keys,
        "_open",
        said.alias("_said"),
        (~F.col("_open") | (said & yes("nutrient"))).alias("name_ok"),
        *((F.col(f"{k}_ok") | (said & yes(c))).alias(f"{k}_ok") for k, c in fields.items()),
        *(F.coalesce(f"{c}_reason", F.lit("")).alias(f"_{c}") for c in ("nutrient", *fields.values())),
    )
    all_ = F.col("qty_ok") & F.col("unit_ok") & F.col("ctx_ok")
    told = lambda c, otherwise: F.when(F.col("_said"), F.col(f"_{c}")).otherwise(otherwise).alias(f"{c}_reason")
    name = F.when(F.col("_open"), "no match").when(all_, "exact/substring match").otherwise("substring match")
    right = {"qty": "numeric match", "unit": "alias match", "ctx": "alias match"}
    return rows.select(
        *keys,
        *(f"{k}_ok" for k in ("name", *fields)),
        F.when(F.col("_said"), "fast+llm").otherwise("fast").alias("method"),
        told("nutrient", name),
        *(told(c, F.when(F.col(f"{k}_ok"), right[k]).otherwise("mismatch")) for k, c in fields.items()),
        (F.col("name_ok") & all_).alias("full"),
    )


def match(gold: DataFrame, pred: DataFrame, least: float = 2.0) -> DataFrame:
    """Pair details: first pairs equal in all four fields, then the rest by score, each tuple used once."""
    c = candidates(gold, pred)
    full = F.col("name_ok") & F.col("qty_ok") & F.col("unit_ok") & F.col("ctx_ok")
    # Fully equal pairs come first in one strict order, so one pass gives both; the flags travel with the pairs.
    ranked = c.where(F.col("name_ok") & (full | (F.col("score") >= least))).withColumn("_own", F.col("score")).withColumn("score", F.when(full, F.lit(100.0)).otherwise(F.col("score")))
    taken = greedy(ranked).withColumn("score", F.col("_own")).drop("_own")
    return taken.withColumn("full_3f", F.col("qty_ok") & F.col("unit_ok")).withColumn("full_4f", F.col("full_3f") & F.col("ctx_ok"))


def first_fit(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(image_id, g, p): each gold tuple in order takes the first free predicted one whose name holds it or is held by it."""
    pairs = gold.select("image_id", "g", F.lower("nutrient").alias("x")).join(pred.select("image_id", "p", F.lower("nutrient").alias("y")), "image_id").where(F.contains("x", F.col("y")) | F.contains("y", F.col("x")))
    return greedy(pairs.withColumn("score", F.lit(0.0)), by_score=False).select("image_id", "g", "p")


def per_image(gold: DataFrame, pred: DataFrame, matched: DataFrame) -> DataFrame:
    """(image_id, gt, pred, match, qty_pct, unit_pct, ctx_pct, full3f_pct, full4f_pct) of images in either table."""
    n = lambda df, name: df.groupBy("image_id").agg(F.count("*").alias(name))
    hit = lambda c: F.count_if(c).alias(f"_{c}")
    m = matched.groupBy("image_id").agg(F.count("*").alias("match"), *map(hit, ("qty_ok", "unit_ok", "ctx_ok", "full_3f", "full_4f")))
    out = n(gold, "gt").join(n(pred, "pred"), "image_id", "full_outer").join(m, "image_id", "left").na.fill(0)
    pct = lambda c: F.bround(100.0 * F.col(f"_{c}") / F.greatest("match", F.lit(1))).cast("long")
    names = {"qty_ok": "qty_pct", "unit_ok": "unit_pct", "ctx_ok": "ctx_pct", "full_3f": "full3f_pct", "full_4f": "full4f_pct"}
    return out.select("image_id", "gt", "pred", "match", *(pct(c).alias(a) for c, a in names.items()))


def prf(tp: Column, n_pred: Column, n_gold: Column) -> list[Column]:
    """precision, recall, f1; 0 where undefined."""
    p = F.when(n_pred > 0, tp / n_pred).otherwise(0.0)
    r = F.when(n_gold > 0, tp / n_gold).otherwise(0.0)
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1")]


def metrics(gold: DataFrame, pred: DataFrame, matched: DataFrame) -> DataFrame:
    """One row: totals, name F1, field accuracies, 3- and 4-field F1 and the cost of the context in points."""
    one = gold.agg(F.count("*").alias("n_gold")).join(pred.agg(F.count("*").alias("n_pred"))).join(matched.agg(F.count("*").alias("tp"), F.count_if("qty_ok").alias("qty"), F.count_if("unit_ok").alias("unit"), F.count_if("ctx_ok").alias("ctx"), F.count_if("full_3f").alias("full3"), F.count_if("full_4f").alias("full4")))
    f1 = lambda c: prf(F.col(c), F.col("n_pred"), F.col("n_gold"))[2]
    out = one.select("*", *prf(F.col("tp"), F.col("n_pred"), F.col("n_gold")), f1("full3").alias("f1_3f"), f1("full4").alias("f1_4f"), *(F.round(F.col(c) / F.greatest("tp", F.lit(1)), 6).alias(f"{c}_acc") for c in ("qty", "unit", "ctx")))
    return out.withColumn("context_cost_pp", F.round(100 * (F.col("f1_3f") - F.col("f1_4f")), 4))


def diff(gold: DataFrame, pred: DataFrame, matched: DataFrame) -> DataFrame:
    """(image_id, g, p, match): every pair and every tuple without one, with how far it matches."""
    kind = F.when(F.col("full_4f"), "Full 4f").when(F.col("full_3f"), "Full 3f").when(F.col("name_ok"), "Partial").otherwise("Mismatch")
    lone = lambda df, key, name: df.select("image_id", *(F.col(c) if c == key else F.lit(None).cast("long").alias(c) for c in ("g", "p")), F.lit(name).alias("match"), F.lit(False).alias("_pair"))
    rows = matched.select("image_id", "g", "p", kind.alias("match"), F.lit(True).alias("_pair")).unionByName(lone(gold, "g", "GT only")).unionByName(lone(pred, "p", "Pred only"))
    # The pairs are matched once; an image's tuples look for their own number among those taken.
    taken = lambda c: F.coalesce(F.array_contains(F.collect_set(F.when(F.col("_pair"), F.col(c))).over(Window.partitionBy("image_id")), F.col(c)), F.lit(False))
    rows = rows.withColumns({"_g": taken("g"), "_p": taken("p")})
    return rows.where(F.col("_pair") | ~(F.col("_g") | F.col("_p"))).select("image_id", "g", "p", "match")


def without_prefix(gold: DataFrame, names: DataFrame, n: int = 12) -> DataFrame:
    """Gold tuples for which no name of the image holds their first ``n`` characters, or begins with ``n`` that they hold, whatever the case."""
    x, y = F.lower(F.coalesce("nutrient", F.lit(""))), F.lower("_name")
    held = F.contains(y, F.substring(x, 1, n)) | F.contains(x, F.substring(y, 1, n))
    seen = names.select("image_id", F.col("nutrient").alias("_name")).where("_name is not null").distinct()
    return gold.join(seen.withColumnRenamed("image_id", "_image"), (F.col("image_id") == F.col("_image")) & held, "left_anti")


def analysis(gold: DataFrame, pred: DataFrame, matched: DataFrame) -> DataFrame:
    """(image_id, g, tag, reason) of gold tuples that are missing or matched but wrong."""
    m = gold.select("image_id", "g").join(matched, ["image_id", "g"], "left")
    reason = F.concat_ws("+", *(F.when(~F.col(c), F.lit(n)) for c, n in (("qty_ok", "qty"), ("unit_ok", "unit"), ("ctx_ok", "ctx"))))
    return m.where(F.col("p").isNull() | ~F.col("full_4f")).select("image_id", "g", F.when(F.col("p").isNull(), F.lit("missing")).otherwise(F.lit("incorrect")).alias("tag"), reason.alias("reason"))
