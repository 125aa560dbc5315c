"""The corpus pipeline: language, near duplicates, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns a DataFrame; all but the last return the columns of ``docs``.

Edge cases: null, empty and letterless texts go with the language stage, which
names no language for them; rows with a null doc_id stay in the stages that
decide by doc_id, since no decision can name them; rows that repeat a doc_id
share its decision; columns called like ones an operator adds are returned as
they came; empty tables give empty results; texts of any length are whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelgraph.llm.decontaminate import contamination
from labelgraph.llm.language_id import identify_language
from labelgraph.llm.ngram_jaccard import ngram_jaccard_join
from labelgraph.llm.packing import pack
from labelgraph.llm.secrets import find_secrets
from labelgraph.llm.store import relieved, table, written

_USED = ("doc_id", "text", "lang")


def _aside(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns that no stage uses under names that clash with none."""
    return docs.toDF(*(c if c in _USED else f"_in{i}" for i, c in enumerate(docs.columns)))


def _back(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, in order and by their names."""
    return out.select(*_aside(docs).columns).toDF(*docs.columns)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    relieved(spark)
    return _back(identify_language(_aside(docs)).where("not rejected"), docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least doc_id; blank ones stay."""
    relieved(spark)
    gone = ngram_jaccard_join(docs).where("component_id < doc_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    relieved(spark)
    found = written(contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret span replaced by a mark, and n_chars, where there is one, as long as the text then is."""
    relieved(spark)
    out = find_secrets(_aside(docs), replace="[secret]")
    if "n_chars" in docs.columns:
        n = f"_in{docs.columns.index('n_chars')}"
        out = out.withColumn(n, F.when(F.size("secrets") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n)))
    return _back(out, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    relieved(spark)
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", languages),
    ("ngram_jaccard_join", one_of_each),
    ("decontamination", without_benchmark),
    ("secret_scan", without_secrets),
    ("best_fit_packing", packed),
]

#: Language models, automata and tokenizers have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
