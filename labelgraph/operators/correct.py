"""Token correction: rules that rewrite, drop, split or merge tokens."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import rules as R


def rewrite(tokens: DataFrame) -> DataFrame:
    """Border strip (an emptied token goes), decimal separators, unit characters, context headers, targeted fixes.

    Adds ``original`` and ``rules_fired`` (names of the rules that changed the token, in order).
    """
    # Each step is a column of its own, so that the next one and the record of changes read it without repeating it.
    out = tokens.withColumns({"original": F.col("token"), "_t0": F.col("token")})
    out = out.withColumn("_t1", F.trim(F.btrim("_t0", F.lit(R.BORDER))))
    out = out.withColumn("_t2", _where(F.col("_t1"), R.DECIMAL))
    # Every unit pattern holds one of these strings; few tokens do, and none gets one later.
    out = out.withColumn("_u", F.col("_t2").rlike("m9|[pUu]g"))
    for i, (p, r, _) in enumerate(R.UNIT_FIXES, 3):
        t = F.col(f"_t{i - 1}")
        out = out.withColumn(f"_t{i}", F.when(F.col("_u"), F.regexp_replace(t, p, r)).otherwise(t))
    names = ["border", "decimal", *(f"unit_{name}" for _, _, name in R.UNIT_FIXES), "context"]
    n = len(names)
    out = out.withColumn(f"_t{n}", _context_header(F.col(f"_t{n - 1}")))
    last = F.col(f"_t{n}")
    out = out.withColumn("_fixed", _where(last, R.TARGETED))
    none = F.array().cast("array<string>")
    step = F.array_compact(F.array(*(F.when(F.col(f"_t{i}") != F.col(f"_t{i - 1}"), F.lit(name)) for i, name in enumerate(names, 1))))
    fired = F.when(last != F.col("_t0"), step).otherwise(none)
    # Which of the many targeted fixes fired is asked of changed tokens only, in the body of a lambda.
    changed = lambda t: F.array_compact(F.array(*(F.when(R.fold(t, R.TARGETED[: i + 1]) != R.fold(t, R.TARGETED[:i]), F.lit(f"targeted_{i}")) for i in range(len(R.TARGETED)))))
    fixes = F.when(F.col("_fixed") != last, F.transform(F.array(last), changed)[0]).otherwise(none)
    out = out.withColumn("_fired", F.concat(fired, fixes))
    return R.once(out, token=F.col("_fixed"), rules_fired=F.col("_fired")).drop("_u", "_fixed", "_fired", *(f"_t{i}" for i in range(n + 1))).where("token <> ''").select(*tokens.columns, "original", "rules_fired")


def _where(t: Column, rules: list[tuple[str, str]]) -> Column:
    """``R.fold`` of the few texts in which a pattern is found; the others stay as they are.

    The folds are in the body of a lambda and so out of generated code.
    """
    found = t.rlike(R.either(p for p, _ in rules))
    # Without a digit only patterns that need none are tried.
    plain = [p for p, _ in rules if "[0-9]" not in p]
    found = F.when(t.rlike("[0-9]"), found).otherwise(t.rlike(R.either(plain)) if plain else F.lit(False))
    return F.when(found, F.transform(F.array(t), lambda x: R.fold(x, rules))[0]).otherwise(t)


def _context_header(t: Column) -> Column:
    low = F.lower(t)
    return F.when(~low.rlike("^(?:je|pr|per)"), t).when(low.rlike(R.CONTEXT_100G), F.when(low.startswith("je"), F.lit("je 100g")).otherwise(F.lit("pro 100g"))).when(low.rlike(R.CONTEXT_100ML), F.lit("per 100ml")).when(low.rlike(R.CONTEXT_10G), F.lit("pro 10g")).otherwise(t)


def _may_be_fused(t: Column) -> Column:
    """Fused texts begin with the energy word, or with a number that a letter of a unit or a slash follows."""
    return F.lower(t).rlike("^energie|^[<>~]?[0-9][^a-zµ/]*[a-zµ/]")


def parts_of(t: Column) -> Column:
    """Array of (text, rule) that a fused token stands for; one part with a null rule if it is not fused."""
    low = F.lower(t)
    get = lambda pattern, i: F.regexp_extract(t, "(?i)" + pattern, i)
    part = lambda text, rule: F.struct(text.alias("text"), F.lit(rule).cast("string").alias("rule"))
    unfused = F.regexp_replace(t, R.NRV_TAIL, "")
    tail = F.when(low.rlike(R.FUSED), t).when((F.length(unfused) >= 2) & F.lower(unfused).rlike(R.FUSED), F.trim(unfused))
    number = lambda c: F.expr("1") if c is None else F.regexp_replace(c, ",", ".").try_cast("double")
    return (
        F.when(~_may_be_fused(t), F.array(part(t, None)))
        .when(low.rlike(R.ENERGY_WORD.lower()) & F.upper(t).rlike("^ENERGIELW"), F.array(part(F.lit("ENERGIE"), "energy_word")))
        .when(low.rlike(R.ENERGY_WORD.lower()), F.array(part(F.lit("ENERGIE"), "energy_word"), part(F.substring(t, 8, 100), "energy_word")))
        .when(low.rlike(R.ENERGY_PAIR), F.array(*(part(get(R.ENERGY_PAIR, i), "energy_pair") for i in (1, 2, 3, 4))))
        .when(low.rlike(R.ENERGY_UNIT), F.array(*(part(get(R.ENERGY_UNIT, i), "energy_unit") for i in (1, 2))))
        .when(low.rlike(R.NUMBERS_SLASH) & (F.greatest(number(get(R.NUMBERS_SLASH, 1)), number(get(R.NUMBERS_SLASH, 2))) >= 100), F.array(*(part(get(R.NUMBERS_SLASH, i), "numbers") for i in (1, 2))))
        .when(t.isin(*R.PROTECTED) | tail.isNull(), F.array(part(t, None)))
        .otherwise(F.array(*(part(F.trim(F.regexp_extract(tail, "(?i)" + R.FUSED, i)), "fused") for i in (1, 2))))
    )


def split(tokens: DataFrame) -> DataFrame:
    """Fused tokens become several rows (``part`` from 0), the box dealt in proportion to text lengths; ``rule`` says why."""
    # Most tokens have no parts and no array of them.
    parts = tokens.withColumn("_parts", F.when(_may_be_fused(F.col("token")), parts_of(F.col("token")))).withColumn("_all", F.expr("CASE WHEN size(_parts) > 1 THEN aggregate(_parts, 0, (a, p) -> a + length(p.text)) END"))
    rows = parts.select("*", F.posexplode_outer("_parts").alias("part", "_p"))
    before = F.expr("CASE WHEN size(_parts) > 1 THEN aggregate(slice(_parts, 1, part), 0, (a, p) -> a + length(p.text)) END")
    width = F.col("x2") - F.col("x1")
    total = F.greatest(F.col("_all"), F.lit(1)).cast("double")
    left = F.col("x1") + width * before / total
    right = left + width * F.length("_p.text") / total
    many = F.size("_parts") > 1
    rows = rows.withColumn("_l", left).withColumn("_r", right)
    return rows.select(
        *[c for c in tokens.columns if c not in ("token", "x1", "x2", "cx")],
        F.coalesce("part", F.lit(0)).cast("long").alias("part"),
        F.when(F.col("_p").isNull(), F.col("token")).otherwise(F.col("_p.text")).alias("token"),
        F.col("_p.rule").alias("rule"),
        F.when(many, F.col("_l").cast("long")).otherwise(F.col("x1")).alias("x1"),
        F.when(many, F.col("_r").cast("long")).otherwise(F.col("x2")).alias("x2"),
        F.when(many, (F.col("_l") + F.col("_r")) / 2).otherwise(F.col("cx")).alias("cx"),
    )


def split_in_two(tokens: DataFrame, share: float = 0.6) -> DataFrame:
    """Tokens of a number and a unit in one box: two rows, the box cut at ``share``; cx stays that of the whole."""
    fused = F.lower("token").rlike(r"^[0-9].*[a-zµ%]$") & (F.size(F.split("token", " ")) <= 2)
    number, unit = F.regexp_extract("token", r"^([0-9.,<>]+)", 1), F.trim(F.regexp_replace("token", r"^[0-9.,<>]+", ""))
    cut = (F.col("x1") + (F.col("x2") - F.col("x1")) * share).cast("long")
    whole = F.array(F.struct(F.col("token"), "x1", "x2"))
    two = F.array(F.struct(number.alias("token"), "x1", cut.alias("x2")), F.struct(unit.alias("token"), cut.alias("x1"), "x2"))
    out = tokens.select(*[c for c in tokens.columns if c not in ("token", "x1", "x2")], F.posexplode(F.when(fused & (unit != ""), two).otherwise(whole)).alias("half", "_p"))
    return out.select("*", "_p.token", "_p.x1", "_p.x2").drop("_p").withColumn("half", F.col("half").cast("long"))


def merge_micro(tokens: DataFrame, gap: int = 30, dy: int = 15) -> DataFrame:
    """Join a token ``µ`` to the next ``g``, and a number before it to both; the joined ones go. Order is tok_idx."""
    w = Window.partitionBy("image_id").orderBy("tok_idx")
    near = lambda a, b: (F.col(f"{b}.x1") - F.col(f"{a}.x2") <= gap) & (F.abs(F.col(f"{a}.cy") - F.col(f"{b}.cy")) <= dy)
    me = F.struct("token", "x1", "x2", "cy")
    t = tokens.withColumn("s0", me).withColumn("s1", F.lead(me, 1).over(w)).withColumn("s2", F.lead(me, 2).over(w)).withColumn("p1", F.lag(me, 1).over(w)).withColumn("p2", F.lag(me, 2).over(w))
    starts = lambda a: F.col(f"{a}.token").rlike("µ$")
    pair = lambda a, b: F.coalesce(starts(a) & (F.col(f"{b}.token") == "g") & near(a, b), F.lit(False))
    triple = lambda a, b, c: F.coalesce(F.col(f"{a}.token").rlike("^[0-9.,]+$") & (F.col(f"{b}.token") == "µ") & pair(b, c) & near(a, b), F.lit(False))
    gone = pair("p1", "s0") | triple("p1", "s0", "s1")
    out = t.withColumn("three", triple("s0", "s1", "s2")).withColumn("two", pair("s0", "s1")).where(~gone)
    token = F.when(F.col("three"), F.concat("token", F.lit("µg"))).when(F.col("two"), F.concat("token", F.lit("g"))).otherwise(F.col("token"))
    x2 = F.when(F.col("three"), F.col("s2.x2")).when(F.col("two"), F.col("s1.x2")).otherwise(F.col("x2"))
    return out.withColumn("token", token).withColumn("x2", x2).withColumn("merged", F.col("two") | F.col("three")).select(*tokens.columns, "merged")


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two strings by longest matching blocks (0 to 1); null if either is."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def snap(tokens: DataFrame, lexicon: DataFrame, least: float = 0.8, shortest: int = 5, length_gap: int = 4) -> DataFrame:
    """Tokens of ``shortest`` or more letters become the lexicon term (term) most like them, at ``least`` or more.

    Only distinct token texts are compared; the lexicon is a rule table of fixed size.
    """
    words = tokens.select(F.lower("token").alias("word")).where(F.length("word") >= shortest).distinct()
    pairs = words.join(F.broadcast(lexicon.select("term")), F.abs(F.length("word") - F.length("term")) <= length_gap)
    best = pairs.withColumn("score", ratio("word", "term")).where(F.col("score") >= least).groupBy("word").agg(F.max_by(F.struct("term", "score"), F.struct("score", F.negative(F.ascii("term")), "term")).alias("b"))
    out = tokens.join(best, F.lower("token") == F.col("word"), "left")
    return out.select(*tokens.columns, F.coalesce("b.term", "token").alias("snapped"), F.col("b.score").alias("snap_score"))


def edit_snap(tokens: DataFrame, lexicon: DataFrame, most: int = 2, shortest: int = 5) -> DataFrame:
    """(word, term, distance): each distinct word's nearest terms by edit distance, first by name among equals."""
    words = tokens.select(F.lower("token").alias("word")).where(F.length("word") >= shortest).distinct()
    pairs = words.join(F.broadcast(lexicon.select("term")), F.abs(F.length("word") - F.length("term")) <= most).withColumn("distance", F.levenshtein("word", "term").cast("long")).where(F.col("distance") <= most)
    return pairs.groupBy("word").agg(F.min(F.struct("distance", "term")).alias("m")).select("word", "m.term", "m.distance")


def merge_compounds(tokens: DataFrame, prefixes: tuple[str, ...] = ("davon", "vitamin", "vitamin c"), followers: int = 4, dy: float = 20, gap: float = 80) -> DataFrame:
    """A prefix token takes up to ``followers`` next tokens of its line, near it, up to a number; taken ones go.

    Takes depend on earlier ones, so the tokens of each image are one sorted array, folded in place.
    """
    fields = {"tok_idx": "long", "token": "string", "x1": "long", "x2": "long", "y1": "long", "y2": "long", "cy": "double"}
    images = tokens.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(*(F.col(c).cast(t).alias(c) for c, t in fields.items())))).alias("_all"))
    kept = "struct<" + ",".join(f"{c}:{t}" for c, t in fields.items()).replace(":long", ":bigint") + ",n_merged:bigint>"

    def step(s: Column, b: Column) -> Column:
        a = F.get(s, F.size(s) - 1)
        near = a["open"] & (a["t"]["n_merged"] < followers) & (F.abs(b["cy"] - a["t"]["cy"]) <= dy) & (b["x1"] - a["t"]["x2"] <= gap) & ~b["token"].rlike("^[0-9]")
        t = a["t"]
        grown = F.struct(t["tok_idx"].alias("tok_idx"), F.concat(t["token"], F.lit(" "), b["token"]).alias("token"), t["x1"].alias("x1"), F.greatest(t["x2"], b["x2"]).alias("x2"), F.least(t["y1"], b["y1"]).alias("y1"), F.greatest(t["y2"], b["y2"]).alias("y2"), t["cy"].alias("cy"), (t["n_merged"] + 1).alias("n_merged"))
        fresh = F.struct(*(b[c].alias(c) for c in fields), F.lit(0).cast("long").alias("n_merged"))
        item = lambda x, o: F.struct(x.alias("t"), o.alias("open"))
        added = F.array_append(s, item(fresh, F.lower(b["token"]).isin(*prefixes)))
        return F.when(F.coalesce(near, F.lit(False)), F.array_append(F.slice(s, F.lit(1), F.size(s) - 1), item(grown, F.lit(True)))).otherwise(added)

    merged = F.aggregate("_all", F.array().cast(f"array<struct<t:{kept},open:boolean>>"), step)
    return images.select("image_id", F.inline(F.transform(merged, lambda x: x["t"]))).select("image_id", "tok_idx", "token", "x1", "x2", "y1", "y2", "n_merged")


def merge_across_lines(tokens: DataFrame, heads: tuple[str, ...] = ("davon", "energie"), back: int = 7, dy: float = 60, dx: float = 140) -> DataFrame:
    """(image_id, tok_idx, head_idx): tokens that continue the nearest head token at most ``back`` places before, on the next line."""
    w = Window.partitionBy("image_id").orderBy("tok_idx").rowsBetween(-back, -1)
    head = F.when(F.lower("token").isin(*heads), F.struct("tok_idx", "cx", "cy"))
    t = tokens.withColumn("h", F.last(head, ignorenulls=True).over(w))
    below = F.col("cy") - F.col("h.cy")
    return t.where((below > 0) & (below <= dy) & (F.abs(F.col("cx") - F.col("h.cx")) <= dx) & ~F.col("token").rlike("^[0-9<]")).select("image_id", "tok_idx", F.col("h.tok_idx").alias("head_idx"))


def split_header_units(tokens: DataFrame) -> DataFrame:
    """``Name (unit)`` becomes a name and a unit row (``piece`` 0 and 1)."""
    pattern = r"^(.*[A-Za-zäöüß])\s*\((mg|g|µg|kJ|kcal|ml)\)$"
    hit = F.col("token").rlike(pattern)
    pieces = F.when(hit, F.array(F.regexp_extract("token", pattern, 1), F.regexp_extract("token", pattern, 2))).otherwise(F.array("token"))
    return tokens.select(*[c for c in tokens.columns if c != "token"], F.posexplode(pieces).alias("piece", "token")).withColumn("piece", F.col("piece").cast("long"))


def canonical_names(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """``canonical``: by the whole normalised token, else its first segment at ``/`` or ``|``, else a vitamin's letter, else null.

    ``names`` (name, canonical) is a rule table of fixed size.
    """
    table = F.broadcast(names)
    t = tokens.withColumn("_n", R.normal(F.col("token"))).withColumn("_s", F.trim(F.element_at(F.split("_n", "[/|]"), 1)))
    whole = table.select(F.col("name").alias("_n"), F.col("canonical").alias("_a"))
    first = table.select(F.col("name").alias("_s"), F.col("canonical").alias("_b"))
    vitamin = F.when(F.col("_n").rlike(r"^vitamin\s+[a-z][0-9]*"), F.concat(F.lit("vitamin "), F.regexp_extract("_n", r"^vitamin\s+([a-z][0-9]*)", 1)))
    out = t.join(whole, "_n", "left").join(first, "_s", "left").withColumn("canonical", F.coalesce("_a", "_b", vitamin))
    return out.select(*tokens.columns, F.col("_n").alias("norm_name"), "canonical")


def unmapped(named: DataFrame) -> DataFrame:
    """(norm_name, n): names without a canonical one, and how often."""
    return named.where("canonical is null").groupBy("norm_name").agg(F.count("*").alias("n"))


def literal_fixes(tokens: DataFrame) -> DataFrame:
    """Border characters off both ends, then the literal replacements in order; empty tokens go."""
    t = F.btrim("token", F.lit(R.BORDER))
    for old, new in R.LITERALS:
        t = F.replace(t, F.lit(old), F.lit(new))
    return tokens.withColumn("token", F.trim(t)).where("token <> ''")


def split_scientific(tokens: DataFrame) -> DataFrame:
    """Tokens (token, x1, x2) such as ``3.6x10^9KBE`` in two, the box cut by length; ``part`` is 0 and 1, or 0 alone."""
    pattern = "(?i)" + R.SCIENTIFIC
    value, unit = (F.trim(F.regexp_extract("token", pattern, i)) for i in (1, 2))
    cut = F.col("x1") + (F.col("x2") - F.col("x1")) * F.length("_value") / F.greatest(F.length("token"), F.lit(1))
    whole = F.array(F.struct(F.col("token").alias("token"), F.col("x1").cast("double").alias("x1"), F.col("x2").cast("double").alias("x2")))
    two = F.array(F.struct(F.col("_value").alias("token"), F.col("x1").cast("double").alias("x1"), cut.alias("x2")), F.struct(F.col("_unit").alias("token"), cut.alias("x1"), F.col("x2").cast("double").alias("x2")))
    kept = [c for c in tokens.columns if c not in ("token", "x1", "x2")]
    parts = tokens.withColumns({"_value": value, "_unit": unit}).select(*kept, F.posexplode(F.when(F.col("_unit") != "", two).otherwise(whole)).alias("part", "_p"))
    return parts.select(*kept, F.col("part").cast("long").alias("part"), "_p.token", "_p.x1", "_p.x2")


def rewrite_counts(tokens: DataFrame) -> DataFrame:
    """``rewrite`` of the distinct tokens; ``n`` is how many each stands for."""
    return rewrite(tokens.groupBy("token").agg(F.count("*").alias("n")))


def report(rewritten: DataFrame) -> DataFrame:
    """(rule, n): how many tokens each rule changed; a row stands for ``n`` tokens where it has that column."""
    n = F.sum("n") if "n" in rewritten.columns else F.count("*")
    fired = F.explode("rules_fired").alias("rule")
    return rewritten.select(fired, *(["n"] if "n" in rewritten.columns else [])).groupBy("rule").agg(n.alias("n"))


def flags(tokens: DataFrame) -> DataFrame:
    """(flag, n_tokens, n_images) of suspicious tokens."""
    found = F.array_compact(F.array(*(F.when(F.col("token").rlike(p), F.lit(name)) for p, name in R.SUSPICIOUS)))
    return tokens.select("image_id", F.explode(found).alias("flag")).groupBy("flag").agg(F.count("*").alias("n_tokens"), F.countDistinct("image_id").alias("n_images"))


def multi_pass(passes: list[DataFrame]) -> DataFrame:
    """Union of OCR passes without empty texts and degenerate boxes."""
    out = passes[0]
    for p in passes[1:]:
        out = out.unionByName(p)
    return out.where("trim(token) <> '' and x2 > x1 and y2 > y1")


def first_level(text: Column) -> Column:
    """Trimmed, the text corrector's first level in order, white space single."""
    return F.trim(F.regexp_replace(_where(F.trim(text), R.FIRST_LEVEL), r"\s+", " "))


def correct_texts(tokens: DataFrame) -> DataFrame:
    """(token, corrected, n) of the distinct tokens that the first level changes, and how many each stands for."""
    words = R.once(tokens.groupBy("token").agg(F.count("*").alias("n")).withColumn("_c", first_level(F.col("token"))), corrected=F.col("_c"))
    return words.where("corrected <> token").select("token", "corrected", "n")
