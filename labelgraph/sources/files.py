"""Gold annotations, token dumps, tuples and graphs as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GOLD = "image_id string, nutrients array<struct<nutrient:string,quantity:string,unit:string,context:string,nrv_percent:string,serving_size:string>>"
FLAT = ["image_id", "nutrient", "quantity", "unit", "context", "nrv_percent", "serving_size"]
TOKENS = "image_id string, tok_idx int, token string, x1 int, y1 int, x2 int, y2 int, cx double, cy double, conf double"


def image_name(c: Column) -> Column:
    """File name without folders, its suffix in lower case."""
    name = F.regexp_replace(c, r"^.*[/\\]", "")
    return F.concat(F.regexp_replace(name, r"\.[A-Za-z]+$", ""), F.lower(F.regexp_extract(name, r"(\.[A-Za-z]+)$", 1)))


def image_order(c: Column) -> list[Column]:
    """Sort keys: numeric stems by number first, then names."""
    stem = F.regexp_replace(c, r"\.[A-Za-z]+$", "")
    return [F.asc_nulls_last(F.when(stem.rlike("^[0-9]+$"), stem.try_cast("long"))), F.asc(c)]


def with_serving(context: Column, serving: Column) -> Column:
    """``context (serving)`` where there is a serving and no bracket yet."""
    return F.when((F.coalesce(serving, F.lit("")) != "") & ~F.contains(F.coalesce(context, F.lit("")), F.lit("(")), F.concat(F.coalesce(context, F.lit("")), F.lit(" ("), serving, F.lit(")"))).otherwise(context)


def decimal_commas(line: Column) -> Column:
    """Quoted decimal commas between digits of a CSV line become dots."""
    return F.regexp_replace(line, r'"([0-9]+),([0-9]+)"', "$1.$2")


def read_gold_json(spark: SparkSession, path: str) -> DataFrame:
    """Flat gold rows of per-image JSON files; the file name stands in for a missing image_id."""
    raw = spark.read.option("multiLine", True).schema(GOLD).json(path)
    name = F.regexp_replace(image_name(F.input_file_name()), r"\.json$", "")
    rows = raw.select(image_name(F.coalesce("image_id", name)).alias("image_id"), F.explode("nutrients").alias("n")).select("image_id", "n.*")
    return rows.withColumn("context", with_serving(F.col("context"), F.col("serving_size")))


def read_gold_csv(spark: SparkSession, path: str, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """Flat gold rows of a CSV file whose columns may have other names or case."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").option("encoding", "UTF-8").csv(path)
    have = {c.lower().lstrip("﻿").strip(): c for c in raw.columns}
    names = {f: [f, *(aliases or {}).get(f, [])] for f in FLAT}
    pick = lambda f: next((F.col(f"`{have[n]}`") for n in names[f] if n in have), F.lit(None).cast("string"))
    return raw.select(*(pick(f).cast("string").alias(f) for f in FLAT)).withColumn("image_id", image_name(F.col("image_id")))


def read_flat_text(spark: SparkSession, path: str, fields: list[str] = FLAT) -> DataFrame:
    """Lines of a text file with as many comma-separated fields as ``fields``, but for the header."""
    parts = F.split(F.col("value"), ",")
    rows = spark.read.text(path).where((F.size(parts) == len(fields)) & (F.lower("value") != ",".join(fields)))
    return rows.select(*(F.trim(parts[i]).alias(f) for i, f in enumerate(fields)))


def nest(rows: DataFrame) -> DataFrame:
    """One row an image with its tuples as an array, for per-image JSON."""
    fields = [c for c in rows.columns if c != "image_id"]
    return rows.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("nutrients"))


def flat(nested: DataFrame) -> DataFrame:
    return nested.select("image_id", F.explode("nutrients").alias("n")).select("image_id", "n.*")


def subset(rows: DataFrame, stems: DataFrame) -> DataFrame:
    """Rows of the images named in ``stems`` (stem)."""
    return rows.withColumn("_s", F.regexp_replace("image_id", r"\.[A-Za-z]+$", "")).join(stems.select(F.col("stem").alias("_s")), "_s", "left_semi").drop("_s")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def write_evaluation(tables: dict[str, DataFrame], path: str) -> None:
    """Each evaluation table below ``path``."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def append_note(spark: SparkSession, path: str, key: str, note: str) -> None:
    spark.createDataFrame([(key, note)], "key string, note string").withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def latest_notes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("key").agg(F.max_by("note", "at").alias("note"))


def gold_fields(rows: DataFrame) -> DataFrame:
    """The five gold columns, trimmed, null as empty; raises if one is missing."""
    names = ("image_id", "nutrient", "quantity", "unit", "context")
    if absent := [c for c in names if c not in rows.columns]:
        raise ValueError(f"missing columns: {absent}")
    return rows.select(*(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in names))
