"""Tuples from running text: paragraphs and sentences, used where the graph finds too little."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R

_NAME = re.compile("|".join(sorted((n for n in R.NUTRIENTS), key=lambda n: (-len(n), n))), re.I)
_AMOUNT = re.compile(r"([0-9]+(?:[.,][0-9]+)?)\s*(mg|µg|kg|kj|kcal|ml|g)\b", re.I)
_SENTENCE = re.compile(r"(?:enthält|contains|contient|liefert|provides)\s+([0-9]+(?:[.,][0-9]+)?)\s*(mg|µg|g)\s+([A-Za-zäöüß]+)", re.I)
TUPLE = "image_id long, ord long, nutrient string, quantity string, unit string, context string"


def gate(tokens: DataFrame, tuples: DataFrame, few: int = 8, long: int = 60, amounts: int = 8) -> DataFrame:
    """(image_id): few tuples, two long tokens and many quantities: the label is a paragraph."""
    n = tuples.groupBy("image_id").agg(F.count("*").alias("n"))
    t = tokens.groupBy("image_id").agg(F.count_if(F.length("token") > long).alias("long"), F.sum(F.regexp_count("token", F.lit(r"[0-9]+([.,][0-9]+)?\s*(mg|µg|g|kj|kcal)"))).alias("amounts"))
    return t.join(n, "image_id", "left").where((F.coalesce("n", F.lit(0)) < few) & (F.col("long") >= 2) & (F.col("amounts") >= amounts)).select("image_id")


def contexts_of(text: str) -> list[str]:
    """Contexts that a paragraph speaks of, in order: 100 g or ml, other amounts after per or a slash (a second one counts as a daily dose), a daily dose; 100 g if none."""
    low = text.lower()
    found = ["per_100g"] if re.search(r"(per|pro|je)\s*(/per\s*)?100\s*(g|ml)", low) or "100 g" in low or "100g" in low else []
    for amount, _ in re.findall(r"(?:per|pro|je|/)\s*([0-9]+[.,]?[0-9]*)\s*(g|ml)", low):
        if amount != "100":
            found += ["per_serving"] if "per_serving" not in found else []
            if len(found) >= 2 and "per_daily_dose" not in found:
                found.append("per_daily_dose")
                break
    if re.search(r"(tagesdosis|daily\s*dose|tagesration)", low) and "per_daily_dose" not in found:
        found.append("per_daily_dose")
    return found or ["per_100g"]


def paragraphs(texts: DataFrame, reach: int = 80, most: int = 3) -> DataFrame:
    """Tuples of (image_id, text): a name, then up to three amounts near it and before the next name, paired with the text's contexts in order."""

    def walk(batches):
        for batch in batches:
            rows = []
            for image, text in zip(batch["image_id"], batch["text"], strict=True):
                contexts, names, n = contexts_of(text or ""), list(_NAME.finditer(text or "")), 0
                for i, m in enumerate(names):
                    stop = min(m.end() + reach, names[i + 1].start() if i + 1 < len(names) else len(text))
                    for k, a in enumerate(list(_AMOUNT.finditer(text, m.end(), stop))[:most]):
                        rows.append((image, n, m[0], a[1].replace(",", "."), a[2].lower(), contexts[k] if k < len(contexts) else None))
                        n += 1
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TUPLE.split(", ")])

    return texts.select("image_id", "text").mapInPandas(walk, TUPLE)


def sentences(texts: DataFrame) -> DataFrame:
    """(image_id, nutrient, quantity, unit): ``contains 5 mg Zink`` and the like, each once."""
    pattern = r"(?i)(?:enthält|contains|contient|liefert|provides)\s+([0-9]+(?:[.,][0-9]+)?)\s*(mg|µg|g)\s+([A-Za-zäöüß]+)"
    found = texts.select("image_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("s"))
    part = lambda i: F.regexp_extract("s", pattern, i)
    return found.select("image_id", part(3).alias("nutrient"), F.regexp_replace(part(1), ",", ".").alias("quantity"), F.lower(part(2)).alias("unit")).distinct()


# Names that sentences are searched for, the longest first.
KNOWN = tuple(sorted((
    "vitamin a", "vitamin b1", "vitamin b2", "vitamin b3", "vitamin b5", "vitamin b6", "vitamin b12", "vitamin c", "vitamin d", "vitamin d3", "vitamin e", "vitamin k", "vitamin k2",
    "colecalciferol", "cholecalciferol", "thiamin", "riboflavin", "niacin", "folsaure", "folsäure", "folic acid", "biotin", "pantothensaure", "pantothensäure", "pantothenic acid",
    "magnesium", "calcium", "kalzium", "kalium", "potassium", "zink", "zinc", "eisen", "iron", "selen", "selenium", "jod", "iodine", "kupfer", "copper", "mangan", "manganese",
    "chrom", "chromium", "molybdan", "molybdenum", "natrium", "sodium", "phosphor", "phosphorus", "omega-3", "omega 3", "epa", "dha", "kreatin", "creatine", "inositol", "choline", "cholin",
    "coenzym q10", "coenzyme q10", "q10", "l-carnitin", "l-carnitine", "l-arginin", "l-arginine", "glucosamin", "glucosamine", "msm",
), key=lambda n: (-len(n), n)))
_NUMBER, _UNIT = r"([0-9]+[.,]?[0-9]*)", r"(µg|ug|mcg|mg|g|kg|ml|I\.?E\.?|IU|IE|kcal|kJ)"
# Kinds of sentence with the groups of name, quantity and unit; 0: the name stands nearby.
FAMILIES = {
    "holds": (rf"(?i)enth[aä]lt\s+{_NUMBER}\s*{_UNIT}\s+([A-Za-zäöüßéè][A-Za-z0-9_äöüßéèÄÖÜ-]+)", 3, 1, 2),
    "international": (rf"(?i){_NUMBER}\s*(I\.?E\.?|IU|IE)\s+([A-Za-zäöüßéè][A-Za-z0-9_äöüßéèÄÖÜ\s-]+?)([.,\s]|$)", 3, 1, 2),
    "equal": (rf"(?i)entsprechend\s+{_NUMBER}\s*{_UNIT}", 0, 1, 2),
    "daily": (rf"(?i)tagesdosis\s+(?:bis\s+zu\s+)?{_NUMBER}\s*{_UNIT}", 0, 1, 2),
    "known": (rf"(?i)({'|'.join(KNOWN)})\s+{_NUMBER}\s*{_UNIT}", 1, 2, 3),
}


def sentence_tuples(texts: DataFrame, reach: int = 80) -> DataFrame:
    """(image_id, nutrient, key, quantity, unit, context) of (image_id, text): statements of five kinds, each name (``key`` in lower case), quantity and unit once, in the form met first.

    Statements without a name of their own take the longest known one in the ``reach``
    characters before them (for daily doses also after them), or give nothing.
    """
    found = None
    for i, (kind, (pattern, name, quantity, unit)) in enumerate(FAMILIES.items()):
        hits = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        part = lambda k, p=pattern: F.regexp_extract("_s", p, k)
        if name:
            rows = texts.select("image_id", F.explode(hits).alias("_s"))
            own = F.trim(part(name))
            text = F.initcap(F.lower(own)) if kind == "known" else own
        else:
            pieces = texts.select("image_id", "text", hits.alias("_m"), F.split("text", pattern).alias("_p")).select("*", F.posexplode("_m").alias("_i", "_s"))
            before = F.concat(F.array_join(F.transform(F.slice("_p", 1, F.col("_i")), lambda p, j: F.concat(p, F.get(F.col("_m"), j))), ""), F.get(F.col("_p"), F.col("_i")))
            pieces = pieces.withColumn("_b", before)
            near = F.right(F.col("_b"), F.lit(reach))
            if kind == "daily":
                near = F.concat(near, F.col("_s"), F.substring(F.col("text"), F.length("_b") + F.length("_s") + 1, F.lit(reach)))
            rows = pieces.withColumn("_near", F.lower(near)).withColumn("_n", F.get(F.filter(F.array(*map(F.lit, KNOWN)), lambda n: F.contains(F.col("_near"), n)), F.lit(0))).where("_n is not null")
            text = F.initcap("_n")
        rows = rows.select("image_id", F.lit(i).alias("_k"), text.alias("nutrient"), F.replace(part(quantity), F.lit(","), F.lit(".")).alias("quantity"), part(unit).alias("_u"))
        found = rows if found is None else found.unionByName(rows)
    bare = F.lower(F.replace("_u", F.lit("."), F.lit("")))
    unit = F.when(bare.isin("ie", "iu"), "IE").when(bare.isin("µg", "ug", "mcg"), "µg").otherwise(F.trim("_u"))
    first = found.withColumn("unit", unit).groupBy("image_id", F.lower("nutrient").alias("key"), "quantity", "unit").agg(F.min(F.struct("_k", "nutrient")).alias("_f"))
    return first.select("image_id", "_f.nutrient", "key", "quantity", "unit", F.lit("per_daily_dose").alias("context"))


def replace_if_more(tuples: DataFrame, other: DataFrame) -> DataFrame:
    """By image: the table with more rows, the first among equals."""
    n = lambda df, c: df.groupBy("image_id").agg(F.count("*").alias(c))
    better = n(other, "b").join(n(tuples, "a"), "image_id", "left").where(F.col("b") > F.coalesce("a", F.lit(0))).select("image_id")
    return tuples.join(better, "image_id", "left_anti").unionByName(other.join(better, "image_id", "left_semi"))


def only_without(tuples: DataFrame, other: DataFrame) -> DataFrame:
    """``tuples`` and the rows of ``other`` for images that have none."""
    return tuples.unionByName(other.join(tuples.select("image_id"), "image_id", "left_anti"), allowMissingColumns=True)
