"""Rows, columns, roles, headers, streams, ranks and confidence of labelled tokens; serialization.

All windows are partitioned by image, whose tokens are few; images are many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R

ROW_GAP, COLUMN_GAP, HEADER_ROWS, ROLE_SHARE = 25.0, 60.0, 2, 0.4



def scale(*by: str) -> Column:
    """Resolution of the image against 500 pixels of height, 1 or more."""
    return F.greatest(F.max("y2").over(Window.partitionBy("image_id", *by)) / F.lit(500.0), F.lit(1.0))


def geometry(tokens: DataFrame) -> DataFrame:
    """Adds width, height, reading direction (dx, dy), normal (nx, ny) and angle_deg.

    The direction is that of the first edge of ``quad``, an array of (x, y) corners from the top left
    one on, where the column is there and has four; else, and where the edge has no length, it is
    level, from left to right.
    """
    x, y = F.lit(1.0), F.lit(0.0)
    if "quad" in tokens.columns:
        at = lambda i, k: F.get(F.get(F.col("quad"), F.lit(i)), F.lit(k)).cast("double")
        ex, ey = at(1, 0) - at(0, 0), at(1, 1) - at(0, 1)
        size = F.sqrt(ex * ex + ey * ey)
        real = (F.size("quad") == 4) & (size >= 1e-8)
        x, y = F.when(real, ex / size).otherwise(1.0), F.when(real, ey / size).otherwise(0.0)
    t = tokens.withColumns({"width": F.col("x2") - F.col("x1"), "height": F.col("y2") - F.col("y1"), "dx": x, "dy": y})
    return t.withColumns({"nx": F.negative("dy") + 0.0, "ny": F.col("dx"), "angle_deg": F.degrees(F.atan2("dy", "dx"))})


def polygon_box(quad: Column) -> list[Column]:
    """x1, y1, x2, y2 of an array of (x, y) points, rounded half to even."""
    at = lambda i: F.transform(quad, lambda p: p[i])
    return [F.bround(f(at(i))).cast("long").alias(n) for n, f, i in (("x1", F.array_min, 0), ("y1", F.array_min, 1), ("x2", F.array_max, 0), ("y2", F.array_max, 1))]


def displacement(a: str, b: str) -> tuple[Column, Column]:
    """Parts of the way from a to b along a's direction and along its normal."""
    x, y = F.col(f"{b}.cx") - F.col(f"{a}.cx"), F.col(f"{b}.cy") - F.col(f"{a}.cy")
    return x * F.col(f"{a}.dx") + y * F.col(f"{a}.dy"), x * F.col(f"{a}.nx") + y * F.col(f"{a}.ny")


def compatible(tokens: DataFrame, most: float = ROW_GAP, angle: float = 15.0) -> DataFrame:
    """(image_id, a, b, row_ok, row_conf, col_ok, col_conf, same_way) of all token pairs a < b of an image."""
    g = geometry(tokens)
    along, across = displacement("a", "b")
    dot = F.col("a.dx") * F.col("b.dx") + F.col("a.dy") * F.col("b.dy")
    same = F.degrees(F.acos(F.least(F.lit(1.0), F.abs(dot)))) <= angle
    conf = lambda d: F.when(F.abs(d) <= most, F.round(1 - F.abs(d) / most, 4)).otherwise(0.0)
    pairs = g.alias("a").join(g.alias("b"), (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.tok_idx") < F.col("b.tok_idx")))
    return pairs.select("a.image_id", F.col("a.tok_idx").alias("a"), F.col("b.tok_idx").alias("b"), (same & (F.abs(across) <= most)).alias("row_ok"), conf(across).alias("row_conf"), (same & (F.abs(along) <= most)).alias("col_ok"), conf(along).alias("col_conf"), same.alias("same_way"))


def compatible_totals(tokens: DataFrame, most: float = ROW_GAP, angle: float = 15.0) -> DataFrame:
    """(image_id, rows_ok, cols_ok, row_conf, col_conf) summed over the pairs of ``compatible``, confidences in 1/10000.

    The tokens of an image meet in one row, and of the pairs only those near along or across are compared further; the others add nothing.
    """
    g = geometry(tokens).select("image_id", "tok_idx", "cx", "cy", "dx", "dy", "nx", "ny")
    node = F.struct(*(c for c in g.columns if c != "image_id"))
    images = g.groupBy("image_id").agg(F.collect_list(node).alias("_all"))
    pairs = images.select("image_id", "_all", F.explode("_all").alias("a")).select("image_id", "a", F.explode("_all").alias("b")).where("a.tok_idx < b.tok_idx")
    along, across = displacement("a", "b")
    dot = F.col("a.dx") * F.col("b.dx") + F.col("a.dy") * F.col("b.dy")
    same = F.degrees(F.acos(F.least(F.lit(1.0), F.abs(dot)))) <= angle
    near = lambda d: F.abs(d) <= most
    conf = lambda d: F.sum(F.when(near(d), F.round(F.round(1 - F.abs(d) / most, 4) * 10000).cast("long")).otherwise(F.lit(0).cast("long")))
    return pairs.groupBy("image_id").agg(F.count_if(near(across) & same).alias("rows_ok"), F.count_if(near(along) & same).alias("cols_ok"), conf(across).alias("row_conf"), conf(along).alias("col_conf"))


def _groups(tokens: DataFrame, at: str, gap: Column, name: str, *by: str) -> DataFrame:
    order = Window.partitionBy("image_id", *by).orderBy(at, "tok_idx")
    new = F.coalesce((F.col(at) - F.lag(at).over(order) > gap).cast("long"), F.lit(0).cast("long"))
    return tokens.withColumn("_new", new).withColumn(name, F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def induce(tokens: DataFrame, row_gap: float = ROW_GAP, column_gap: float = COLUMN_GAP, scaled: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds row_id and column_id: a new group begins where the gap to the previous token along the axis exceeds the limit.

    ``by``: columns whose values are kept apart besides images.
    """
    s = scale(*by) if scaled else F.lit(1.0)
    t = tokens.withColumn("scale", s)
    return _groups(_groups(t, "cy", row_gap * F.col("scale"), "row_id", *by), "cx", column_gap * F.col("scale"), "column_id", *by)


def deskew(tokens: DataFrame, near: float = 200.0) -> DataFrame:
    """(image_id, n, slope): the upper median of the slopes between tokens of a line, and their number."""
    pairs = tokens.alias("a").join(tokens.alias("b"), (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.tok_idx") < F.col("b.tok_idx")) & (F.abs(F.col("a.cx") - F.col("b.cx")) <= near) & (F.abs(F.col("a.cx") - F.col("b.cx")) >= 1) & (F.abs(F.col("a.cy") - F.col("b.cy")) <= 10))
    slope = (F.col("b.cy") - F.col("a.cy")) / (F.col("b.cx") - F.col("a.cx"))
    all_ = pairs.groupBy("a.image_id").agg(F.sort_array(F.collect_list(slope)).alias("s"))
    return all_.select("image_id", F.size("s").cast("long").alias("n"), F.expr("s[cast(size(s) div 2 as int)]").alias("slope"))


def _role(n: Column, most: Column, top: Column) -> Column:
    name = F.when(top == "NUTRIENT", "NUTRIENT").when(top.isin("QUANTITY", "CONTEXT"), "DOSAGE").when(top == "UNIT", "UNIT").otherwise("MIXED")
    return F.when((n < 2) | (most / n < ROLE_SHARE), F.lit("MIXED")).otherwise(name)


def column_roles(grouped: DataFrame) -> DataFrame:
    """(image_id, column_id, role, top, n): the most frequent label, first seen among equals, if it holds 40 %."""
    counts = grouped.groupBy("image_id", "column_id", "label").agg(F.count("*").alias("c"), F.min(F.struct("cy", "tok_idx")).alias("first"))
    top = counts.groupBy("image_id", "column_id").agg(F.sum("c").alias("n"), F.min(F.struct(F.negative("c").alias("k"), "first", "label", "c")).alias("m"))
    return top.select("image_id", "column_id", _role(F.col("n"), F.col("m.c"), F.col("m.label")).alias("role"), F.col("m.label").alias("top"), "n")


def with_roles(grouped: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds column_role and dosage_stream_id to the tokens themselves, by windows alone: no shuffle beyond that by image."""
    column = Window.partitionBy("image_id", *by, "column_id")
    label = Window.partitionBy("image_id", *by, "column_id", "label")
    t = grouped.withColumn("_c", F.struct(F.negative(F.count("*").over(label)).alias("k"), F.min(F.struct("cy", "tok_idx")).over(label).alias("first"), F.col("label").alias("label")))
    t = t.withColumns({"_m": F.min("_c").over(column), "_n": F.count("*").over(column)})
    t = t.withColumn("column_role", _role(F.col("_n"), F.negative("_m.k"), F.col("_m.label")))
    stream = F.dense_rank().over(Window.partitionBy("image_id", *by, "column_role").orderBy("column_id")) - 1
    return t.withColumn("dosage_stream_id", F.when(F.col("column_role") == "DOSAGE", stream).otherwise(-1).cast("long")).drop("_c", "_m", "_n")


def headers(grouped: DataFrame, rows: int = HEADER_ROWS, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds is_header (a CONTEXT in the first rows) and column_context_id (of the column's last header)."""
    t = grouped.withColumn("is_header", (F.col("label") == "CONTEXT") & (F.col("row_id") <= rows))
    own = F.when(F.col("is_header"), F.coalesce("norm", F.lower("token")))
    column = Window.partitionBy("image_id", *by, "column_id")
    return t.withColumn("column_context_id", F.max_by(own, F.when(F.col("is_header"), F.col("tok_idx"))).over(column))


def streams(roles: DataFrame) -> DataFrame:
    """Adds dosage_stream_id: the running number of the image's DOSAGE columns, else -1."""
    order = Window.partitionBy("image_id").orderBy("column_id").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum((F.col("role") == "DOSAGE").cast("long")).over(order)
    return roles.withColumn("dosage_stream_id", F.when(F.col("role") == "DOSAGE", n - 1).otherwise(F.lit(-1).cast("long")))


def ranks(t: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds rank_in_row, and ranks in the column among data, quantities and names; -1 where they do not count."""
    row = Window.partitionBy("image_id", *by, "row_id").orderBy("cx", "tok_idx")
    col = Window.partitionBy("image_id", *by, "column_id").orderBy("cy", "tok_idx").rowsBetween(Window.unboundedPreceding, 0)
    data = ~F.col("is_header")
    running = lambda c: F.when(c, F.sum(c.cast("long")).over(col) - 1).otherwise(F.lit(-1).cast("long"))
    return t.withColumns({"rank_in_row": F.row_number().over(row).cast("long") - 1, "data_rank_in_column": running(data), "qty_rank_in_column": running(data & (F.col("label") == "QUANTITY")), "nutrient_rank_in_column": running(data & (F.col("label") == "NUTRIENT"))})


def confidence(grouped: DataFrame, group: str, at: str, most: float) -> DataFrame:
    """(image_id, group, conf): mean closeness along ``at`` of the pairs in each group, 1 if it has one token."""
    g = grouped.select("image_id", group, "tok_idx", at, "scale")
    pairs = g.alias("a").join(g.alias("b"), (F.col("a.image_id") == F.col("b.image_id")) & (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a.tok_idx") < F.col("b.tok_idx")))
    d = F.abs(F.col(f"a.{at}") - F.col(f"b.{at}")) / (most * F.col("a.scale"))
    mean = pairs.groupBy("a.image_id", f"a.{group}").agg(F.round(F.avg(F.greatest(F.lit(0.0), 1 - d)), 4).alias("conf"))
    return g.select("image_id", group).distinct().join(mean, ["image_id", group], "left").withColumn("conf", F.coalesce("conf", F.lit(1.0)))


#: What enrichment adds, null on NOISE rows.
ADDED = ("scale", "row_id", "column_id", "column_context_id", "column_role", "dosage_stream_id", "rank_in_row", "data_rank_in_column", "qty_rank_in_column", "nutrient_rank_in_column")


def enrich(labelled: DataFrame) -> DataFrame:
    """All of the above on the tokens that are not NOISE; NOISE rows stay, with is_enriched false and nothing added.

    One shuffle by image serves all steps; NOISE tokens form window partitions of their own.
    """
    by = ("is_enriched",)
    # Dealt by image alone, which is what the steps after this one group by.
    t = labelled.withColumn("is_enriched", F.col("label") != "NOISE").repartition("image_id")
    t = ranks(with_roles(headers(induce(t, by=by), by=by), by), by)
    return t.withColumns({c: F.when(F.col("is_enriched"), F.col(c)) for c in ADDED})


def meet(labelled: DataFrame, **lists: Column) -> DataFrame:
    """One row an image with tokens that are not NOISE: its scale, and an array of each of the columns, of the tokens that have one."""
    # The columns are made where tokens are read; the grouping only gathers them.
    kept = labelled.where("label <> 'NOISE'").select("image_id", "y2", *(c.alias(k) for k, c in lists.items()))
    return kept.groupBy("image_id").agg(F.greatest(F.max("y2") / F.lit(500.0), F.lit(1.0)).alias("scale"), *(F.collect_list(k).alias(k) for k in lists))


def _bounds(images: DataFrame, xs: Column, ys: Column) -> DataFrame:
    """``images`` with ``_xs``, where columns but the first begin, and ``_ys``, where the first row that holds no headers does."""
    begins = lambda at, gap: F.filter(at, lambda x, i: x - F.get(F.col(at), i - 1) > gap * F.col("scale"))
    g = R.once(images, _xs=F.sort_array(F.array_distinct(xs)), _ys=F.sort_array(F.array_distinct(ys)))
    return R.once(g, _xs=begins("_xs", COLUMN_GAP), _ys=F.get(begins("_ys", ROW_GAP), F.lit(HEADER_ROWS)))


def _column(x: Column) -> Column:
    return F.size(F.filter("_xs", lambda b: b <= x["cx"])).cast("long")


def _in_header(x: Column) -> Column:
    return F.coalesce(x["cy"] < F.col("_ys"), F.lit(True))


def image_nodes(labelled: DataFrame) -> DataFrame:
    """(image_id, nodes): the tokens that are not NOISE in order of id, with their box, label, scale, column_id and is_header as ``enrich`` adds them, but no text."""
    box = ("cx", "cy", "x1", "y1", "x2", "y2", "label")
    g = meet(labelled, nodes=F.struct(F.col("tok_idx").alias("id"), *box))
    g = _bounds(g, F.col("nodes")["cx"], F.col("nodes")["cy"])
    node = lambda x: F.struct(*(x[c].alias(c) for c in ("id", *box)), F.col("scale").alias("scale"), _column(x).alias("column_id"), ((x["label"] == "CONTEXT") & _in_header(x)).alias("is_header"))
    return R.once(g, nodes=F.sort_array(F.transform("nodes", node))).select("image_id", "nodes")


#: Labels whose tokens ``by_image`` keeps whole, by the name of their array.
LISTS = {"names": "NUTRIENT", "qs": "QUANTITY", "us": "UNIT", "cs": "CONTEXT"}


def by_image(labelled: DataFrame, **more: Column) -> DataFrame:
    """One row an image: its tokens as arrays of structs with what ``enrich`` adds, for steps that need all tokens of an image at once.

    ``names``, ``qs``, ``us``, ``cs`` (by label) and ``rest`` (only the place of the others that are not NOISE), each in order of
    column, height and id; ``ps`` and ``servings``, the percentages and serving sizes; ``columns`` with their role. ``more`` are further
    columns of the labelled tokens, for all but ``rest`` and ``servings``. Tokens are grouped where they are read, so one row an
    image and task is shuffled, and nothing is sorted by more than the image but its arrays.
    """
    kept, label = F.col("label") != "NOISE", F.col("label")
    # The fields that order a list come first. A list's label is not carried along.
    place = ("cy", "id", "label", "cx")
    fields = (*place, "token", "norm", "x1", "y1", "x2", "y2", *more)
    own = {"id": F.col("tok_idx"), **more}
    node = lambda names: F.struct(*(own.get(f, F.col(f)).alias(f) for f in names))
    whole = node([f for f in fields if f != "label"])
    lists = {
        **{k: F.when(label == x, whole) for k, x in LISTS.items()},
        "rest": F.when(kept & ~label.isin(*LISTS.values()), node(place)),
        "ps": F.when(~kept & (F.col("reference") == "NRV"), whole),
        "servings": F.when(~kept & (F.col("reference") == "SERVING"), node(("id", "token"))),
    }
    # The columns are made where tokens are read; the grouping only gathers them.
    t = labelled.select("image_id", F.when(kept, F.col("y2")).alias("_y2"), *(c.alias(k) for k, c in lists.items()))
    g = t.groupBy("image_id").agg(F.greatest(F.max("_y2") / F.lit(500.0), F.lit(1.0)).alias("scale"), *(F.collect_list(k).alias(k) for k in lists))
    every = lambda f: F.concat(*(F.col(k)[f] for k in (*LISTS, "rest")))
    g = _bounds(g, every("cx"), every("cy"))

    def placed(k: str) -> Column:
        of = lambda x, f: F.lit(LISTS[k]) if f == "label" and k in LISTS else x[f]
        return F.sort_array(F.transform(k, lambda x: F.struct(_column(x).alias("column_id"), *(of(x, f).alias(f) for f in (place if k == "rest" else fields)))))

    header = _in_header
    g = R.once(g, **{k: placed(k) for k in (*LISTS, "rest")})
    light = lambda k: F.transform(k, lambda x: F.struct(*(x[f].alias(f) for f in ("column_id", "cy", "id", "label"))))
    heads = F.transform(F.filter("cs", header), lambda x: F.struct(x["column_id"].alias("column_id"), x["id"].alias("id"), F.coalesce(x["norm"], F.lower(x["token"])).alias("own")))
    g = R.once(g, _all=F.concat(*map(light, (*LISTS, "rest"))), _heads=heads)

    def of_column(c: Column) -> Column:
        one = lambda m: F.struct(m.alias("m"), F.array_min(F.transform(F.array_distinct(m["label"]), lambda x: first_of(m, x))).alias("top"))
        return F.transform(F.array(F.filter("_all", lambda x: x["column_id"] == c)), one)[0]

    def first_of(m: Column, label: Column) -> Column:
        own = lambda o: F.struct(F.negative(F.size(o)).alias("k"), F.array_min(o).alias("first"), label.alias("label"))
        return F.transform(F.array(F.filter(m, lambda y: y["label"] == label)), own)[0]

    def summed(x: Column, c: Column) -> Column:
        role = _role(F.size(x["m"]), F.negative(x["top"]["k"]), x["top"]["label"])
        context = F.array_max(F.transform(F.filter("_heads", lambda h: h["column_id"] == c), lambda h: F.struct(h["id"].alias("id"), h["own"].alias("own"))))["own"]
        return F.struct(c.alias("column_id"), role.alias("role"), context.alias("context"), F.array_min(x["m"]["id"]).alias("first"))

    ids = F.sequence(F.lit(0).cast("long"), F.size("_xs").cast("long"))
    g = R.once(g, columns=F.transform(ids, lambda c: F.transform(F.array(of_column(c)), lambda x: summed(x, c))[0]))
    g = R.once(g, _dosage=F.filter("columns", lambda c: c["role"] == "DOSAGE")["column_id"], **{f"_{k}": F.col(k)["column_id"] for k in LISTS})

    def enriched(k: str) -> Column:
        none = F.lit(-1).cast("long")

        def one(x: Column, i: Column) -> Column:
            column = F.get(F.col("columns"), x["column_id"].cast("int"))
            rank = (i - F.array_position(F.col(f"_{k}"), x["column_id"]) + 1).cast("long")
            return F.struct(
                *(x[f].alias(f) for f in ("column_id", *fields)),
                F.col("scale").alias("scale"),
                (header(x) if k == "cs" else F.lit(False)).alias("is_header"),
                column["context"].alias("column_context_id"),
                column["role"].alias("column_role"),
                (F.array_position("_dosage", x["column_id"]) - 1).alias("dosage_stream_id"),
                (rank if k == "qs" else none).alias("qty_rank_in_column"),
                (rank if k == "names" else none).alias("nutrient_rank_in_column"),
            )

        return F.transform(k, one)

    g = R.once(g, **{k: enriched(k) for k in LISTS})
    return g.select("image_id", "scale", *LISTS, "rest", "ps", "servings", "columns")


def diagnostics(enriched: DataFrame) -> DataFrame:
    """(image_id, n_tokens, n_noise, n_rows, n_columns, n_headers, n_streams, rank_consistent)."""
    most = lambda c: F.max(F.when(F.col("is_enriched"), F.col(c)))
    return enriched.groupBy("image_id").agg(
        F.count("*").alias("n_tokens"),
        F.count_if(~F.col("is_enriched")).alias("n_noise"),
        F.coalesce(most("row_id") + 1, F.lit(0).cast("long")).alias("n_rows"),
        F.coalesce(most("column_id") + 1, F.lit(0).cast("long")).alias("n_columns"),
        F.count_if("is_header").alias("n_headers"),
        F.coalesce(most("dosage_stream_id") + 1, F.lit(0).cast("long")).alias("n_streams"),
        F.coalesce(most("qty_rank_in_column") == most("nutrient_rank_in_column"), F.lit(False)).alias("rank_consistent"),
    )


def local_thresholds(tokens: DataFrame, reach: int = 3, least: float = 8.0) -> DataFrame:
    """(image_id, tok_idx, threshold): half the median height of the neighbours by place, ``least`` or more."""
    w = Window.partitionBy("image_id").orderBy("cy", "tok_idx").rowsBetween(-reach, reach)
    height = F.when(F.col("y2") > F.col("y1"), (F.col("y2") - F.col("y1")).cast("double"))
    return tokens.select("image_id", "tok_idx", F.greatest(F.lit(least), 0.5 * F.percentile(height, F.lit(0.5)).over(w)).alias("threshold"))


def lines(tokens: DataFrame, reach: int = 3, least: float = 8.0) -> DataFrame:
    """(image_id, tok_idx, line_id): each token goes to the nearest open line within its threshold (as in ``local_thresholds``) of the line's mean, else opens one.

    The sweep runs by cy; lines are numbered by their mean. No mean lies above the token that is looked at, and a line opens
    beyond a threshold above 0 from all, so the last one opened is the nearest and lines are in order as they open. The
    tokens of an image are one sorted array, folded in place.
    """
    height = F.when(F.col("y2") > F.col("y1"), (F.col("y2") - F.col("y1")).cast("double"))
    t = tokens.select("image_id", F.struct(F.col("cy").cast("double").alias("cy"), "tok_idx", height.alias("h")).alias("_x"))
    images = R.once(t.groupBy("image_id").agg(F.collect_list("_x").alias("_all")), _all=F.sort_array("_all"))
    # The middle of the sorted heights, or the mean of the two middle ones.
    middle = lambda s: (F.get(s, F.shiftright(F.size(s) - 1, 1)) + F.get(s, F.shiftright(F.size(s), 1))) / 2
    near = lambda i: F.array_compact(F.slice(F.col("_all")["h"], F.greatest(i + 1 - reach, F.lit(1)), F.least(i, F.lit(reach)) + 1 + reach))
    median = lambda i: F.get(F.transform(F.array(F.sort_array(near(i))), middle), F.lit(0))
    images = R.once(images, _all=F.transform("_all", lambda x, i: F.struct(x["cy"].alias("cy"), x["tok_idx"].alias("tok_idx"), F.greatest(F.lit(float(least)), 0.5 * median(i)).alias("most"))))
    start = F.struct(F.lit(-1).cast("long").alias("line"), F.lit(None).cast("double").alias("mean"), F.lit(0).cast("long").alias("n"), F.array().cast("array<bigint>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        joins = F.coalesce(F.abs(x["cy"] - s["mean"]) <= x["most"], F.lit(False))
        line, n = F.when(joins, s["line"]).otherwise(s["line"] + 1), F.when(joins, s["n"] + 1).otherwise(F.lit(1)).cast("long")
        mean = F.when(joins, s["mean"] + (x["cy"] - s["mean"]) / (s["n"] + 1)).otherwise(x["cy"])
        return F.struct(line.alias("line"), mean.alias("mean"), n.alias("n"), F.array_append(s["out"], line).alias("out"))

    images = R.once(images, _lines=F.aggregate("_all", start, step, lambda s: s["out"]))
    return images.select("image_id", F.inline(F.zip_with("_all", "_lines", lambda t, o: F.struct(t["tok_idx"].alias("tok_idx"), o.alias("line_id")))))


def serialize(tokens: DataFrame, line: str = "ln") -> DataFrame:
    """(image_id, tok_idx, token, start, end): places in the text that joins tokens by blanks and lines by breaks."""
    w = Window.partitionBy("image_id").orderBy(line, "x1", "tok_idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("token") + 1).over(w), F.lit(0)).cast("long")
    return tokens.select("image_id", "tok_idx", "token", start.alias("start"), (start + F.length("token")).alias("end"))


def texts(tokens: DataFrame, line: str = "ln") -> DataFrame:
    """(image_id, text, n_lines)."""
    by_line = tokens.groupBy("image_id", line).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x1", "tok_idx", "token"))), lambda s: s["token"]), " ").alias("s"))
    return by_line.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(line, "s"))), lambda s: s["s"]), "\n").alias("text"), F.count("*").alias("n_lines"))


def prompt_table(tokens: DataFrame) -> DataFrame:
    """(image_id, table): one line a token, its number, text and place, for a model prompt."""
    line = F.concat_ws(" | ", F.col("tok_idx").cast("string"), "token", F.concat_ws(",", *(F.col(c).cast("string") for c in ("x1", "y1", "x2", "y2"))))
    return tokens.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_idx", line.alias("l")))), lambda s: s["l"]), "\n").alias("table"))
