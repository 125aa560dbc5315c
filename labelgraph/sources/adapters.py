"""Token tables from the driver's documents: every word of every text, laid out.

Words are dealt to images of 12 lines of 6 words. Names, quantities, units and
contexts take fixed columns so that all operators have something to do; the
sixth word of a line stays as it is. Only integer arithmetic places them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R

_V = "(image_id % 1000 + 3 * ln + wn)"


def _case(key: str, values: list[str]) -> str:
    n = len(values)
    return f"CASE {key} % {n} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_NAMES = ["Energie", "Fett", "Eiweiß", "Kohlenhydrate", "Zucker", "Salz:", "Vitamin C", "Calcium", "|Eisen|", "Zink", "Eiweib", "Brennwert", "Magnesium", "ENERGIEkJ/kcal"]
_UNITS = ["g", "mg", "µg", "kJ", "kcal", "ug", "m9"]
_CONTEXTS = ["je 100 g", "pro 100ml", "pro Portion", "per day", "Pro 100g (1)"]
_NUMBER = f"CAST(({_V} * 37) % 640 AS STRING)"
_QUANTITY = f"CASE {_V} % 9 WHEN 0 THEN concat({_NUMBER}, ',5') WHEN 1 THEN concat({_NUMBER}, 'mg') WHEN 2 THEN concat({_NUMBER}, '.25') WHEN 3 THEN concat({_NUMBER}, ' kJ/', {_NUMBER}, 'kcal') WHEN 4 THEN concat({_NUMBER}, '/', {_NUMBER}) WHEN 5 THEN concat('<', {_NUMBER}) WHEN 6 THEN concat({_NUMBER}, ' %') ELSE {_NUMBER} END"
TOKEN = f"CASE WHEN ln = 0 AND wn IN (1, 3) THEN {_case(_V, _CONTEXTS)} WHEN wn = 0 THEN {_case(_V, _NAMES)} WHEN wn IN (1, 3) THEN {_QUANTITY} WHEN wn IN (2, 4) THEN {_case(_V, _UNITS)} ELSE word END"
# Geometry in order: each may use the ones before it.
COLUMNS = [
    ("token", TOKEN),
    ("pitch", "CASE image_id % 3 WHEN 0 THEN 24 WHEN 1 THEN 40 ELSE 60 END"),
    ("x1", "CAST(90 * wn + (13 * ln) % 37 AS BIGINT)"),
    ("y1", "CAST(pitch * ln + (5 * wn + image_id) % 9 AS BIGINT)"),
    ("x2", "CAST(x1 + 8 * least(length(token), 9) AS BIGINT)"),
    ("y2", "CAST(y1 + 14 + 2 * (image_id % 3) AS BIGINT)"),
    ("cx", "(x1 + x2) / CAST(2 AS DOUBLE)"),
    ("cy", "(y1 + y2) / CAST(2 AS DOUBLE)"),
    ("conf", "((31 * image_id + 7 * ln + wn) % 100) / CAST(100 AS DOUBLE)"),
]
# Spark's form of TOKEN: the same values, each taken by its place in a list and not by trying one after the other.
_PLACES = {"image_id": "doc_id * 100000 + CAST(k div 72 AS BIGINT)", "tok_idx": "CAST(k % 72 AS BIGINT)", "ln": "CAST((k % 72) div 6 AS BIGINT)", "wn": "CAST(k % 6 AS BIGINT)"}


def _at(values: list[str]) -> str:
    return f"get(array({', '.join(repr(v) for v in values)}), CAST(_v % {len(values)} AS INT))"


_PICK = f"CASE WHEN ln = 0 AND wn IN (1, 3) THEN {_at(_CONTEXTS)} WHEN wn = 0 THEN {_at(_NAMES)} WHEN wn IN (1, 3) THEN {_QUANTITY.replace(_V, '_v')} WHEN wn IN (2, 4) THEN {_at(_UNITS)} ELSE word END"
KEPT = ["image_id", "tok_idx", "ln", "wn", "token", "x1", "y1", "x2", "y2", "cx", "cy", "conf"]


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, where its files are fewer than they are; a table of many files is left as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if len(df.inputFiles()) < cores else df


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, tok_idx, ln, wn, token, x1, y1, x2, y2, cx, cy, conf) of all texts."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    # Given to the generator as it is: as a column, a filter on its size would split each text once more.
    words = docs.select("doc_id", F.posexplode(F.array_remove(F.split(F.coalesce("text", F.lit("")), "[\n ]+"), "")).alias("k", "word"))
    out = words.select(*(F.expr(text).alias(name) for name, text in _PLACES.items()), "word").withColumn("_v", F.expr(_V))
    # The steps after read the token as a column, however often they do.
    out = R.once(out, token=F.expr(_PICK))
    for name, text in COLUMNS[1:]:
        out = out.withColumn(name, F.expr(text))
    return out.select(*KEPT)


def duck_tokens(last: str = "tok") -> str:
    """CTEs ending in ``last``."""
    chain, at = [], "t0"
    for i, (name, text) in enumerate(COLUMNS, 1):
        chain.append(f"t{i} AS (SELECT *, {text} AS {name} FROM {at})")
        at = f"t{i}"
    return (
        "w0 AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\n ]+'), lambda x: x <> '') w FROM documents),\n"
        "w1 AS (SELECT doc_id, i - 1 k, w[i] word FROM w0, unnest(range(1, len(w) + 1)) u(i)),\n"
        "t0 AS (SELECT doc_id * 100000 + k // 72 image_id, k % 72 tok_idx, (k % 72) // 6 ln, k % 6 wn, word FROM w1),\n" + ",\n".join(chain) + f",\n{last} AS (SELECT {', '.join(KEPT)} FROM {at})"
    )
