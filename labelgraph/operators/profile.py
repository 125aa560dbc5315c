"""Sweeps, histograms, data-set and failure profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from .associate import parse_quantity
from .evaluate import prf
from .graph import relations


def sweep(scores: DataFrame, thresholds: int = 46, margins: int = 26, first: int = 30) -> DataFrame:
    """(t, m, tp, fp, fn, tn, precision, recall, f1) over a grid of hundredths; scores (score100, margin100, gold) are integers.

    Scores meet the grid as a histogram: at most 101 x 201 x 2 cells whatever the input, so the product stays small.
    """
    hist = scores.groupBy("score100", "margin100", "gold").agg(F.count("*").alias("n"))
    grid = scores.sparkSession.range(thresholds).select((F.col("id") + first).alias("t")).join(scores.sparkSession.range(margins).select(F.col("id").alias("m")))
    hit = (F.col("score100") >= F.col("t")) & (F.col("margin100") >= F.col("m"))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    gold = F.col("gold") == 1
    cells = hist.join(F.broadcast(grid)).groupBy("t", "m").agg(total(hit & gold).alias("tp"), total(hit & ~gold).alias("fp"), total(~hit & gold).alias("fn"), total(~hit & ~gold).alias("tn"))
    return cells.select("*", *prf(F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")))


def pr_curve(scores: DataFrame) -> DataFrame:
    """(t, precision, recall, f1) of all hundredths as thresholds, without a margin."""
    return sweep(scores, 101, 1, 0).select("t", "precision", "recall", "f1")


def best(cells: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` best cells by f1, in grid order among equals."""
    return cells.orderBy(F.desc("f1"), "t", "m").limit(n)


def histogram(rows: DataFrame, value: str, by: str, width: int = 10) -> DataFrame:
    """(by, bucket, n): integer buckets of ``width``."""
    return rows.groupBy(by, (F.floor(F.col(value) / width)).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def counts_per_group(rows: DataFrame, group: str) -> DataFrame:
    """One row: groups, rows, mean, median, standard deviation, least and most rows of a group."""
    c = rows.groupBy(group).agg(F.count("*").alias("c"))
    return c.agg(F.count("*").alias("groups"), F.sum("c").alias("rows"), F.round(F.avg("c"), 6).alias("mean"), F.median("c").alias("median"), F.round(F.stddev_samp("c"), 6).alias("std"), F.min("c").alias("least"), F.max("c").alias("most"))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """(value, n, share)."""
    c = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return c.join(F.broadcast(c.agg(F.sum("n").alias("_all")))).withColumn("share", F.round(F.col("n") / F.col("_all"), 6)).drop("_all")


def distinct_per_group(rows: DataFrame, group: str, column: str) -> DataFrame:
    """(n_distinct, groups): how many groups have how many distinct values (frequency tiers)."""
    return rows.groupBy(group).agg(F.countDistinct(column).alias("n_distinct")).groupBy("n_distinct").agg(F.count("*").alias("groups"))


def layout(rows: DataFrame, group: str) -> DataFrame:
    """(rows_per_group, groups): groups by how many rows they have, in fixed right-closed buckets up to 999."""
    edges = [0, 2, 5, 10, 15, 20, 30, 50, 999]
    names = ["1-2", "3-5", "6-10", "11-15", "16-20", "21-30", "31-50", "50+"]
    label = F.lit(None).cast("string")
    for hi, name in reversed(list(zip(edges[1:], names, strict=True))):
        label = F.when(F.col("c") <= hi, name).otherwise(label)
    return rows.groupBy(group).agg(F.count("*").alias("c")).groupBy(label.alias("rows_per_group")).agg(F.count("*").alias("groups")).where("rows_per_group is not null")


def coverage(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, n_with, share): rows of each group whose ``value`` is a number."""
    has = F.col(value).rlike(r"^\s*[+-]?[0-9]+(\.[0-9]*)?\s*$")
    c = rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.count_if(has).alias("n_with"))
    return c.withColumn("share", F.round(F.col("n_with") / F.col("n"), 6))


def invalid_contexts(rows: DataFrame) -> DataFrame:
    """Rows whose context is null or none of the valid ones."""
    return rows.where(F.col("context").isNull() | ~F.col("context").isin(*R.VALID_CONTEXTS))


def noisy_images(labelled: DataFrame, least: float = 0.90) -> DataFrame:
    """(image_id, n, n_noise) of images with ``least`` or more of their tokens NOISE."""
    c = labelled.groupBy("image_id").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "NOISE").alias("n_noise"))
    return c.where(F.col("n_noise") >= least * F.col("n"))


def run_totals(labelled: DataFrame) -> DataFrame:
    """One row: images, tokens and the tokens of each label."""
    labels = ("NUTRIENT", "QUANTITY", "UNIT", "CONTEXT", "NOISE", "UNKNOWN")
    return labelled.agg(F.countDistinct("image_id").alias("images"), F.count("*").alias("tokens"), *(F.count_if(F.col("label") == x).alias(f"n_{x.lower()}") for x in labels))


def silent_images(images: DataFrame, tokens: DataFrame) -> DataFrame:
    """Images (image_id) without a token."""
    return images.join(tokens.select("image_id"), "image_id", "left_anti")


def zero_images(images: DataFrame) -> DataFrame:
    """(image_id, gt, pred) of images with gold tuples of which none is fully matched."""
    return images.where("gt > 0 and full4f_pct * match = 0").select("image_id", "gt", "pred")


def node_counts(nodes: DataFrame) -> DataFrame:
    """(kind, value, n): how many nodes have each label and each column role."""
    rows = nodes.select(F.inline(F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(c).alias("value")) for kind, c in (("label", "label"), ("role", "column_role"))))))
    return rows.where("value is not null").groupBy("kind", "value").agg(F.count("*").alias("n"))


def image_diagnostics(labelled: DataFrame, edges: DataFrame, tuples: DataFrame, gold: DataFrame, least_conf: float = 0.30) -> DataFrame:
    """One row an image of any of the tables: its tokens, labels, edges (mirrored ones counted once), tuples, gold tuples, and how many each step lost."""
    label = lambda x: F.count_if(F.col("label") == x).alias(f"clf_{x.lower()}")
    low = (F.col("conf") < least_conf).cast("int")
    out = labelled.groupBy("image_id").agg(F.count("*").alias("ocr_total"), F.sum(low).alias("ocr_low_conf"), *map(label, ("NUTRIENT", "QUANTITY", "UNIT", "CONTEXT", "NOISE", "UNKNOWN")))
    # Edges come one by one, or as numbers ``n`` by image and type.
    many = F.col("n") if "n" in edges.columns else F.lit(1)
    kind = lambda name, *types: (F.sum(F.when(F.col("type").isin(*types), many).otherwise(0)) / (1 if name == "ctx_scope" else 2)).cast("long").alias(f"graph_{name}")
    e = edges.groupBy("image_id").agg(kind("same_row", "SAME_ROW", "ROW_COMPAT"), kind("same_col", "SAME_COL", "COL_COMPAT"), kind("adjacent", "ADJACENT", "DIRECTIONAL_ADJ"), kind("ctx_scope", "CONTEXT_SCOPE"))
    t = tuples.groupBy("image_id").agg(F.count("*").alias("assoc_tuples"), *(F.count_if(F.col(c).isNull()).alias(f"assoc_no_{n}") for c, n in (("quantity", "qty"), ("unit", "unit"), ("context", "ctx"))))
    g = gold.groupBy("image_id").agg(F.count("*").alias("gt_tuples"))
    out = out.join(e, "image_id", "full_outer").join(t, "image_id", "full_outer").join(g, "image_id", "full_outer").na.fill(0)
    none, gt = F.lit(0).cast("long"), F.col("gt_tuples")
    return out.withColumns(
        {
            "ocr_passed": F.col("ocr_total") - F.col("ocr_low_conf"),
            "clf_noise_pct": F.round(100 * F.col("clf_noise") / F.greatest("ocr_total", F.lit(1)), 1),
            "graph_total_edges": sum((F.col(f"graph_{k}") for k in ("same_col", "adjacent", "ctx_scope")), F.col("graph_same_row")),
            "lost_at_ocr": F.greatest(none, gt - F.col("clf_nutrient")),
            "lost_at_clf": F.col("clf_unknown"),
            "lost_at_graph": F.when(F.col("clf_context") > 0, F.greatest(none, gt - F.col("graph_ctx_scope"))).otherwise(none),
            "lost_at_assoc": F.col("assoc_no_qty"),
        }
    )


def image_scores(images: DataFrame) -> DataFrame:
    """(image_id, precision, recall, f1) of the per-image counts."""
    return images.select("image_id", *prf(F.col("match"), F.col("pred"), F.col("gt")))


def extremes(images: DataFrame, n: int = 10) -> DataFrame:
    """(which, image_id, f1): the ``n`` best and worst images, by id among equals; a top-``n`` report."""
    s = image_scores(images).select("image_id", "f1")
    top = s.orderBy(F.desc("f1"), "image_id").limit(n).withColumn("which", F.lit("best"))
    return top.unionByName(s.orderBy("f1", "image_id").limit(n).withColumn("which", F.lit("worst")))


def disagreements(images: DataFrame, gap: float = 0.3) -> DataFrame:
    """(image_id, precision, recall, side) where the two differ by ``gap`` or more."""
    s = image_scores(images).drop("f1").where(F.abs(F.col("precision") - F.col("recall")) >= gap)
    return s.withColumn("side", F.when(F.col("precision") > F.col("recall"), "precision").otherwise("recall"))


def ranking(runs: DataFrame, run: str, value: str) -> DataFrame:
    """(run, mean, std, rank, delta): runs by mean value, their spread and their distance to the best; one row a run."""
    c = runs.groupBy(F.col(run).alias("run")).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("std"))
    top = c.agg(F.max("mean").alias("top"))
    return c.join(top).withColumn("rank", F.rank().over(Window.orderBy(F.desc("mean"))).cast("long")).select("run", "mean", "std", "rank", F.round(F.col("mean") - F.col("top"), 6).alias("delta"))


def rank_alignment(n: DataFrame, e: DataFrame, gold: DataFrame, row: str = "ROW_COMPAT") -> DataFrame:
    """One row: do ranks of names and quantities agree?

    rank_consistent, rank_inconsistent: images whose dosage columns all have as many ranked quantities
    as the first name column has ranked names. with_rank, matched, unmatched: ranked names, those with a
    dosage quantity of their rank in the image, and the others. multi: names with over two
    quantities in their row; multi_correct and multi_wrong: of those that the gold table
    (image_id, g, nutrient, quantity) knows, whether the quantity of the name's rank has the gold value.
    in_order, out_of_order: pairs of an image's names whose first ranked row quantities lie in the same, or in the other, order.
    """
    count = lambda c: F.count_if(F.col(c) >= 0)
    columns = n.where("column_id >= 0").groupBy("image_id", "column_id").agg(F.first("column_role").alias("role"), count("nutrient_rank_in_column").alias("names"), count("qty_rank_in_column").alias("qs"), F.min("id").alias("first"))
    images = columns.groupBy("image_id").agg(F.min(F.when(F.col("role") == "NUTRIENT", F.struct("first", "names"))).alias("n"), F.collect_list(F.when(F.col("role") == "DOSAGE", F.col("qs"))).alias("d"))
    agree = images.where(F.col("n").isNotNull() & (F.size("d") > 0)).select(F.forall("d", lambda x: x == F.col("n.names")).alias("ok"))
    agree = agree.agg(F.count_if("ok").alias("rank_consistent"), F.count_if(~F.col("ok")).alias("rank_inconsistent"))

    q = n.where("label = 'QUANTITY'")
    names = n.where("label = 'NUTRIENT' and nutrient_rank_in_column >= 0").select("image_id", "id", F.col("nutrient_rank_in_column").alias("r"), F.lower("token").alias("text"))
    near = e.where(F.col("type") == row).select("image_id", F.col("src").alias("id"), F.col("dst").alias("q")).join(q.select("image_id", F.col("id").alias("q"), F.col("qty_rank_in_column").alias("qr"), "token"), ["image_id", "q"])
    near = near.groupBy("image_id", "id").agg(F.array_sort(F.collect_list(F.struct("q", "qr", "token"))).alias("near"))
    ranks = q.where("column_role = 'DOSAGE'").groupBy("image_id").agg(F.collect_set("qty_rank_in_column").alias("ranks"))
    golds = gold.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("g", F.lower(F.coalesce("nutrient", F.lit(""))).alias("name"), F.replace(F.coalesce("quantity", F.lit("")), F.lit(","), F.lit(".")).alias("value")))).alias("golds"))
    t = names.join(near, ["image_id", "id"], "left").join(ranks, "image_id", "left").join(golds, "image_id", "left")
    own = F.get(F.filter("near", lambda x: x["qr"] == F.col("r")), F.lit(0))["token"]
    want = F.get(F.filter("golds", lambda x: F.contains(x["name"], F.substring("text", 1, 10)) | F.contains(F.col("text"), F.substring(x["name"], 1, 10))), F.lit(0))["value"]
    t = t.select("*", (F.size("near") > 2).alias("many"), (parse_quantity(own)[0] == want).alias("right"), F.coalesce(F.array_contains("ranks", F.col("r")), F.lit(False)).alias("has"), F.get(F.filter("near", lambda x: x["qr"] >= 0), F.lit(0))["qr"].alias("first_q"))
    sure = F.coalesce(F.col("many"), F.lit(False))
    counts = t.agg(F.count("*").alias("with_rank"), F.count_if("has").alias("matched"), F.count_if(~F.col("has")).alias("unmatched"), F.count_if(sure).alias("multi"), F.count_if(sure & F.col("right")).alias("multi_correct"), F.count_if(sure & ~F.col("right")).alias("multi_wrong"))
    p = t.where("first_q is not null").groupBy("image_id").agg(F.collect_list(F.struct("r", "first_q")).alias("a"))
    signs = F.flatten(F.transform("a", lambda x: F.transform("a", lambda y: F.when(x["r"] < y["r"], F.signum(y["first_q"] - x["first_q"])))))
    order = p.select(F.size(F.filter(signs, lambda v: v > 0)).alias("i"), F.size(F.filter(signs, lambda v: v < 0)).alias("o")).agg(F.coalesce(F.sum("i"), F.lit(0)).alias("in_order"), F.coalesce(F.sum("o"), F.lit(0)).alias("out_of_order"))
    return agree.join(counts).join(order)


def rank_alignment_of_images(images: DataFrame, gold: DataFrame) -> DataFrame:
    """``rank_alignment`` of images whose tokens are arrays (``enrich.by_image``): rows are the nodes' geometry, each image gives its counts, no edge is made."""
    line = F.struct("g", F.lower(F.coalesce("nutrient", F.lit(""))).alias("name"), F.replace(F.coalesce("quantity", F.lit("")), F.lit(","), F.lit(".")).alias("value"))
    golds = gold.groupBy("image_id").agg(F.sort_array(F.collect_list(line)).alias("golds"))
    # Of names and quantities only what is compared.
    part = lambda k, rank: F.transform(k, lambda x: F.struct(x["id"].alias("id"), x["column_id"].alias("c"), x["cy"].alias("cy"), x["scale"].alias("scale"), x[rank].alias("r"), x["column_role"].alias("role"), x["token"].alias("token")))
    first = lambda c: F.get(c, F.lit(0))
    i = R.once(images, names=part("names", "nutrient_rank_in_column"), qs=F.sort_array(part("qs", "qty_rank_in_column")))
    lead = F.array_min(F.transform(F.filter("columns", lambda c: c["role"] == "NUTRIENT"), lambda c: F.struct(c["first"].alias("first"), c["column_id"].alias("c"))))["c"]
    dosage = F.filter("columns", lambda c: c["role"] == "DOSAGE")["column_id"]
    i = R.once(i, _lead=lead, _dosage=dosage, _n=F.col("names")["c"], _q=F.col("qs")["c"], _ranks=F.filter("qs", lambda q: q["role"] == "DOSAGE")["r"])
    held = lambda ids, c: F.size(F.filter(ids, lambda x: x == c))
    agree = F.when(F.col("_lead").isNotNull() & (F.size("_dosage") > 0), F.forall("_dosage", lambda c: held("_q", c) == held("_n", F.col("_lead"))))
    near = F.transform("names", lambda n: F.struct(n["r"].alias("r"), F.lower(n["token"]).alias("text"), F.filter("qs", lambda q: relations(n.getField, q.getField, 1)["row"]).alias("near")))
    i = R.once(i, ok=agree, names=near).join(golds, "image_id", "left")

    def right(n: Column) -> Column:
        own = first(F.filter(n["near"], lambda q: q["r"] == n["r"]))["token"]
        want = first(F.filter("golds", lambda g: F.contains(g["name"], F.substring(n["text"], 1, 10)) | F.contains(n["text"], F.substring(g["name"], 1, 10))))["value"]
        return parse_quantity(own)[0] == want

    many = lambda n: F.size(n["near"]) > 2
    told = lambda n: F.struct(n["r"].alias("r"), F.array_contains("_ranks", n["r"]).alias("has"), many(n).alias("many"), F.when(many(n), right(n)).alias("right"), first(F.filter(n["near"], lambda q: q["r"] >= 0))["r"].alias("q"))
    i = R.once(i.select("ok", "names", "golds", "_ranks"), _t=F.transform("names", told)).select("ok", "_t")
    pairs = F.flatten(F.transform("_t", lambda x: F.transform("_t", lambda y: F.when(x["r"] < y["r"], F.signum(y["q"] - x["q"])))))
    i = R.once(i, _s=pairs)
    number = lambda test: F.size(F.filter("_t", test))
    sums = {"with_rank": F.size("_t"), "matched": number(lambda x: x["has"]), "unmatched": number(lambda x: ~x["has"]), "multi": number(lambda x: x["many"]), "multi_correct": number(lambda x: x["right"]), "multi_wrong": number(lambda x: ~x["right"]), "in_order": F.size(F.filter("_s", lambda v: v > 0)), "out_of_order": F.size(F.filter("_s", lambda v: v < 0))}
    return i.agg(F.count_if("ok").alias("rank_consistent"), F.count_if(~F.col("ok")).alias("rank_inconsistent"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(k) for k, c in sums.items()))


def numeric(c: Column) -> Column:
    """Number of a text with comma or dot, or null."""
    t = F.regexp_replace(F.trim(c), ",", ".")
    return F.when(t.rlike(r"^[+-]?[0-9]+(\.[0-9]*)?$"), t.try_cast("double"))


def buckets(value: Column, edges: list[float]) -> Column:
    """``(lo,hi]`` of the right-closed bucket that holds the value; null outside."""
    out = F.lit(None).cast("string")
    for lo, hi in reversed(list(zip(edges, edges[1:], strict=False))):
        out = F.when((value > lo) & (value <= hi), F.lit(f"({lo:g},{hi:g}]")).otherwise(out)
    return out


def to_grams(value: Column, unit: Column) -> Column:
    factor = F.when(unit == "kg", 1000.0).when(unit == "g", 1.0).when(unit == "mg", 0.001).when(unit.isin("µg", "mcg", "ug"), 0.000001)
    return value * factor


def bins(rows: DataFrame, table: DataFrame) -> DataFrame:
    """(unit, bin, n): values in the closed bins [lo, hi] of their unit; ``table`` (unit, bin, lo, hi) has a few fixed rows."""
    hit = rows.join(F.broadcast(table), "unit").where(F.col("value").between(F.col("lo"), F.col("hi")))
    return hit.groupBy("unit", "bin").agg(F.count("*").alias("n"))


def families(rows: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """(family, n, surface_forms): the first keyword rule that the text contains; ``table`` (rule, keyword, family) has a few fixed rows."""
    names = rows.groupBy(F.lower(column).alias("name")).agg(F.count("*").alias("n"))
    hit = names.join(F.broadcast(table), F.contains("name", F.col("keyword")), "left").groupBy("name", "n").agg(F.min_by("family", "rule").alias("family"))
    return hit.groupBy(F.coalesce("family", F.lit("other")).alias("family")).agg(F.sum("n").alias("n"), F.count("*").alias("surface_forms"))


def missing(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_missing): null or blank values."""
    one = rows.agg(*(F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(c) for c in columns))
    return one.unpivot([], columns, "column", "n_missing")


def segments(rows: DataFrame, column: str) -> DataFrame:
    """(n_segments, n): parts of the text between / or |."""
    n = F.size(F.filter(F.split(column, "[/|]"), lambda s: F.trim(s) != "")).cast("long")
    return rows.groupBy(n.alias("n_segments")).agg(F.count("*").alias("n"))


def decimals(rows: DataFrame, column: str) -> DataFrame:
    """(places, n): digits after the dot or comma."""
    places = F.length(F.regexp_extract(column, r"^[0-9]+[.,]([0-9]+)$", 1)).cast("long")
    return rows.groupBy(places.alias("places")).agg(F.count("*").alias("n"))


def failures(matched: DataFrame) -> DataFrame:
    """(combination, n): which fields are wrong together."""
    combo = F.concat_ws("+", *(F.when(~F.col(c), F.lit(n)) for c, n in (("qty_ok", "qty"), ("unit_ok", "unit"), ("ctx_ok", "ctx"))))
    return matched.where(~F.col("full_4f")).groupBy(combo.alias("combination")).agg(F.count("*").alias("n"))


def wrong_quantities(gold: DataFrame, pred: DataFrame, matched: DataFrame) -> DataFrame:
    """(category, n): a wrong quantity is absent, belongs to another row of the image, or is some other value."""
    wrong = matched.where(~F.col("qty_ok")).select("image_id", "g", "p").join(pred.select("image_id", "p", "quantity"), ["image_id", "p"])
    others = gold.groupBy("image_id").agg(F.collect_set("quantity").alias("qs"))
    c = wrong.join(others, "image_id")
    kind = F.when(F.col("quantity").isNull(), "absent").when(F.array_contains("qs", F.col("quantity")), "other_row").otherwise("other_value")
    return c.groupBy(kind.alias("category")).agg(F.count("*").alias("n"))


def confusions(gold: DataFrame, pred: DataFrame, matched: DataFrame, column: str = "unit", n: int = 15) -> DataFrame:
    """(gold, pred, n): the most frequent wrong pairs of a field; a top-``n`` report."""
    m = matched.join(gold.select("image_id", "g", F.col(column).alias("gold")), ["image_id", "g"]).join(pred.select("image_id", "p", F.col(column).alias("pred")), ["image_id", "p"])
    bad = m.where(~F.coalesce(F.col("gold") == F.col("pred"), F.col("gold").isNull() & F.col("pred").isNull())).groupBy("gold", "pred").agg(F.count("*").alias("n"))
    return bad.orderBy(F.desc("n"), F.asc_nulls_first("gold"), F.asc_nulls_first("pred")).limit(n)


def context_flips(matched: DataFrame) -> DataFrame:
    """(n_flips, n_images): matched but for the context."""
    return matched.where("full_3f and not full_4f").agg(F.count("*").alias("n_flips"), F.countDistinct("image_id").alias("n_images"))


def verdicts(images: DataFrame) -> DataFrame:
    """(verdict, n): GOOD from 80 % of full matches, PARTIAL from 40 %, else POOR."""
    pct = F.col("full4f_pct") * F.col("match") / F.greatest("gt", F.lit(1))
    return images.groupBy(F.when(pct >= 80, "GOOD").when(pct >= 40, "PARTIAL").otherwise("POOR").alias("verdict")).agg(F.count("*").alias("n"))


def targets(images: DataFrame, gap: int = 3) -> DataFrame:
    """(image_id, gap): images that lack ``gap`` or more gold tuples."""
    return images.withColumn("gap", F.col("gt") - F.col("match")).where(F.col("gap") >= gap).select("image_id", "gap")


def timing(rows: DataFrame, group: str, seconds: str) -> DataFrame:
    """(group, n, total, mean, median, least, most)."""
    s = F.col(seconds)
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.round(F.sum(s), 3).alias("total"), F.round(F.avg(s), 6).alias("mean"), F.round(F.median(s), 6).alias("median"), F.round(F.min(s), 6).alias("least"), F.round(F.max(s), 6).alias("most"))


def compare(metrics: DataFrame, baseline: DataFrame, names: list[str]) -> DataFrame:
    """(metric, base, value, delta, direction) of two one-row metric tables."""
    long = lambda df, v: df.select(*(F.col(c).cast("double").alias(c) for c in names)).unpivot([], names, "metric", v)
    out = long(baseline, "base").join(long(metrics, "value"), "metric").withColumn("delta", F.round(F.col("value") - F.col("base"), 6))
    return out.withColumn("direction", F.when(F.col("delta") > 0, "up").when(F.col("delta") < 0, "down").otherwise("same"))


def upgrades(fast: DataFrame, slow: DataFrame) -> DataFrame:
    """(image_id, g, p, was, now): pairs that both evaluations matched, where the full match differs."""
    return fast.select("image_id", "g", "p", F.col("full_4f").alias("was")).join(slow.select("image_id", "g", "p", F.col("full_4f").alias("now")), ["image_id", "g", "p"]).where("was <> now")


def longest(rows: DataFrame, column: str, n: int = 10) -> DataFrame:
    """(value, length): the longest distinct values; a top-``n`` report."""
    return rows.select(F.col(column).alias("value")).distinct().withColumn("length", F.length("value").cast("long")).orderBy(F.desc("length"), "value").limit(n)
