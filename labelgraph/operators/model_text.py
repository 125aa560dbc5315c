"""Text of model replies to tuples: cleaning, JSON with repair and salvage, validation, canonical fields."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import rules as R

ITEM = "array<struct<nutrient:string,quantity:string,unit:string,context:string>>"


def clean(reply: Column) -> Column:
    """Without thinking blocks and code fences."""
    return F.trim(F.regexp_replace(F.regexp_replace(reply, r"(?s)<think>.*?</think>", ""), r"```(json)?", ""))


def full_array(text: Column) -> Column:
    """The JSON array from the first [ to the last ], trailing commas repaired; null if it does not parse."""
    body = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    return F.from_json(F.when(body != "", F.regexp_replace(body, r",\s*([\]}])", "$1")), ITEM)


@F.pandas_udf(ArrayType(StringType()))
def salvage(text: pd.Series) -> pd.Series:
    """Complete objects of a cut-off array, found by brace depth outside strings."""

    def objects(s: str | None) -> list[str]:
        out, depth, start, quoted, escaped = [], 0, 0, False, False
        for i, c in enumerate(s or ""):
            if quoted:
                escaped, quoted = c == "\\" and not escaped, not (c == '"' and not escaped)
            elif c == '"':
                quoted, escaped = True, False
            elif c == "{":
                start = i if depth == 0 else start
                depth += 1
            elif c == "}" and depth:
                depth -= 1
                if depth == 0:
                    try:
                        json.loads(s[start : i + 1])
                        out.append(s[start : i + 1])
                    except ValueError:
                        pass
        return out

    return text.map(objects)


def parse(replies: DataFrame) -> DataFrame:
    """(image_id, parse_mode, idx, nutrient, quantity, unit, context): full, salvaged or fail; items need a name and a quantity."""
    t = replies.withColumn("t", clean(F.col("reply"))).withColumn("full", full_array(F.col("t")))
    t = t.withColumn("parts", F.when(F.col("full").isNull(), F.transform(salvage("t"), lambda o: F.from_json(o, ITEM[6:-1]))))
    items = F.coalesce("full", "parts")
    mode = F.when(F.col("full").isNotNull(), "full").when(F.size("parts") > 0, "salvaged").otherwise("fail")
    rows = t.select("image_id", mode.alias("parse_mode"), F.posexplode_outer(items).alias("idx", "i")).select("image_id", "parse_mode", F.col("idx").cast("long").alias("idx"), "i.*")
    return rows.where("parse_mode = 'fail' or (trim(coalesce(nutrient, '')) <> '' and trim(coalesce(quantity, '')) <> '')")


def clean_unit(c: Column) -> Column:
    t = F.regexp_replace(F.trim(F.lower(c)), "μ", "µ")
    return F.when(t.isin("", "none", "null", "-"), None).when(t.isin("ug", "mcg"), F.lit("µg")).when(t == "ie", F.lit("iu")).otherwise(t)


def clean_quantity(c: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.trim(c), r"\s+", ""), ",", ".")
    return F.regexp_extract(t, r"^([<>~]?[0-9]+(\.[0-9]+)?)", 1)


def canonical_context(c: Column) -> Column:
    t = F.regexp_replace(F.trim(F.lower(c)), r"[_\s]+", " ")
    return F.coalesce(R.first_match(t, [(r"100 ?ml", "per_100ml"), (r"100 ?g", "per_100g"), (r"10 ?g", "per_10g"), (r"(tag|day|dosis|dose)", "per_daily_dose"), (r"(portion|serving)", "per_serving")]), F.when(t != "", t))


def majority_context(rows: DataFrame) -> DataFrame:
    """(image_id, majority): the image's most frequent context but per_10g, first by name among equals."""
    c = rows.where("context is not null and context <> 'per_10g'").groupBy("image_id", "context").agg(F.count("*").alias("n"))
    return c.groupBy("image_id").agg(F.min(F.struct(F.negative("n").alias("k"), "context")).alias("m")).select("image_id", F.col("m.context").alias("majority"))


def dedupe(rows: DataFrame) -> DataFrame:
    """Rows first in their image of equal four fields, whatever the case."""
    keys = [F.coalesce(F.lower(c), F.lit("")) for c in ("nutrient", "quantity", "unit", "context")]
    w = Window.partitionBy("image_id", *keys).orderBy("idx")
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def dropped(rows: DataFrame) -> DataFrame:
    """(image_id, n, n_dropped): rows, and how many of them ``dedupe`` takes away."""
    keys = [F.coalesce(F.lower(c), F.lit("")) for c in ("nutrient", "quantity", "unit", "context")]
    return rows.groupBy("image_id").agg(F.count("*").alias("n"), F.countDistinct(F.struct(*keys)).alias("_d")).select("image_id", "n", (F.col("n") - F.col("_d")).alias("n_dropped"))


def postprocess(parsed: DataFrame) -> DataFrame:
    """Clean fields, then give an ambiguous or missing context the image's majority, then dedupe."""
    unit_in_name = F.regexp_extract(F.lower("nutrient"), r"\((g|mg|µg|kj|kcal)\)$", 1)
    t = parsed.where("parse_mode <> 'fail'").select(
        "image_id", "idx",
        F.trim(F.regexp_replace("nutrient", r"\s*\((g|mg|µg|kJ|kcal)\)$", "")).alias("nutrient"),
        clean_quantity(F.col("quantity")).alias("quantity"),
        F.coalesce(clean_unit(F.col("unit")), F.when(unit_in_name != "", unit_in_name)).alias("unit"),
        canonical_context(F.col("context")).alias("context"),
    )
    t = t.where("quantity <> ''").join(majority_context(t), "image_id", "left")
    t = t.withColumn("context", F.when(F.col("context").isNull() | (F.col("context") == "per_10g"), F.coalesce("majority", "context")).otherwise(F.col("context")))
    return dedupe(t.drop("majority"))
