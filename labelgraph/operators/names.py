"""Canonical names: a staged dictionary for gold names and a cascade of patterns for names that models wrote.

Both work on distinct names, so that the cost of patterns and joins does not grow with repeats.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import name_tables as N

#: Separators of names in several languages, in the order in which they are tried.
SEPARATORS = (" | ", " / ", "/ ", "/")
_DASH = r"^[-–—•]\s*"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean(c: Column) -> Column:
    """Without a leading dash or bullet and trailing colons; runs of dots are slashes, white space is single."""
    s = F.regexp_replace(F.regexp_replace(strip(c), _DASH, ""), ":+$", "")
    return strip(F.regexp_replace(F.regexp_replace(s, r"\s*\.{2,}\s*", " / "), r"\s+", " "))


def _keys(cleaned: Column, stripped: Column) -> list[tuple[str, str, Column]]:
    """(stage, table, key) in the order in which they are looked up."""
    keys = [("exact", "exact", stripped), ("cleaned", "exact", cleaned)]
    for s in SEPARATORS:
        first = F.when(F.contains(cleaned, F.lit(s)), strip(F.substring_index(cleaned, s, 1)))
        keys += [("segment", "exact", first), ("segment", "lower", F.lower(first)), ("segment", "lower", strip(F.regexp_replace(F.lower(first), _DASH, "")))]
    bare = strip(F.regexp_replace(cleaned, r"\*+$", ""))
    return [*keys, ("lower", "lower", F.lower(cleaned)), ("starred", "exact", bare), ("starred", "lower", F.lower(bare))]


def resolve(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``canonical`` and ``stage``: which lookup found it, ``pattern``, or ``text`` for a name kept as cleaned; nulls stay null.

    All lookups of a name are rows of one join with the fixed dictionary; the least stage that finds something counts.
    """
    spark = rows.sparkSession
    table = spark.createDataFrame([("exact", k, v) for k, v in N.EXACT] + [("lower", k, v) for k, v in N.SEGMENTS], "_table string, _key string, _value string")
    names = rows.select(F.col(column).alias("_name")).where("_name is not null").distinct().withColumn("_clean", clean(F.col("_name")))
    keys = _keys(F.col("_clean"), strip(F.col("_name")))
    asked = names.select("_name", F.inline(F.array(*(F.struct(F.lit(i).alias("_at"), F.lit(stage).alias("_stage"), F.lit(t).alias("_table"), k.alias("_key")) for i, (stage, t, k) in enumerate(keys)))))
    # The dictionary is fixed: 231 rows.
    best = asked.where("_key is not null").join(F.broadcast(table), ["_table", "_key"]).groupBy("_name").agg(F.min(F.struct("_at", "_stage", "_value")).alias("_b"))
    pattern = F.when(F.lower("_clean").rlike(r"^koffein\b"), "Caffeine").when(F.lower("_clean").rlike(r"^vitamin\s*a\s*\("), "Vitamin A")
    out = names.join(best, "_name", "left").select("_name", F.coalesce("_b._value", pattern, "_clean").alias("canonical"), F.coalesce("_b._stage", F.when(pattern.isNotNull(), "pattern"), F.lit("text")).alias("stage"))
    return rows.join(out, F.col(column) == F.col("_name"), "left").drop("_name")


def stage_counts(resolved: DataFrame, column: str) -> DataFrame:
    """(stage, names, n): distinct names and rows that each stage resolved."""
    return resolved.where("stage is not null").groupBy("stage").agg(F.countDistinct(column).alias("names"), F.count("*").alias("n"))


def _ascii(c: Column) -> Column:
    return reduce(lambda s, p: F.replace(s, F.lit(p[0]), F.lit(p[1])), N.ASCII, F.lower(c))


def canonicalize(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``canonical`` and ``rule`` (number of the first pattern of the cascade that matches, from 1, else 0).

    A name without a match keeps its text, without what stands in brackets if anything is left; null is empty.
    """
    names = rows.select(F.col(column).alias("_name")).distinct()
    marks = F.replace(F.replace(F.replace(strip(F.coalesce("_name", F.lit(""))), F.lit("μ"), F.lit("µ")), F.lit("–"), F.lit("-")), F.lit("—"), F.lit("-"))
    names = names.withColumn("_raw", F.btrim(F.regexp_replace(marks, r"\s+", " "), F.lit(" .,:;|/\\-_*")))
    names = names.withColumn("_bare", strip(F.regexp_replace("_raw", r"\([^)]*\)", "")))
    names = names.withColumns({"_w": _ascii(F.col("_raw")), "_b": strip(_ascii(F.col("_bare")))})
    rule = F.lit(0)
    for i, (on, pattern, _) in reversed(list(enumerate(N.CASCADE, 1))):
        rule = F.when(F.col(f"_{on}").rlike(pattern), i).otherwise(rule)
    names = names.withColumn("rule", F.when(F.col("_raw") == "", 0).otherwise(rule))
    text = F.when(F.col("_bare") != "", F.col("_bare")).otherwise(F.col("_raw"))
    for i, (on, pattern, value) in enumerate(N.CASCADE, 1):
        if "\\" in value:
            groups = [F.regexp_extract(f"_{on}", pattern, g) for g in range(1, value.count("\\") + 1)]
            result = F.concat(F.lit(value.split("\\")[0]), F.upper(groups[0]), *groups[1:])
            text = F.when(F.col("rule") == i, result).otherwise(text)
    table = F.array(*(F.lit(v) for _, _, v in N.CASCADE))
    literal = F.col("rule").isin(*(i for i, (_, _, v) in enumerate(N.CASCADE, 1) if "\\" not in v))
    names = names.select("_name", "rule", F.when(literal, F.get(table, F.col("rule") - 1)).otherwise(text).alias("canonical"))
    return rows.join(names, F.col(column).eqNullSafe(F.col("_name")), "left").drop("_name")
