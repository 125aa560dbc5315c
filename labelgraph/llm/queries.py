"""Queries of the training-data operators: one ``opN_<name>`` each.

Each runs its operator with production parameters over its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .branch_merge import merge_documents
from .branch_merge import oracle_sql as merge_sql
from .decontaminate import contamination
from .html_text import html_text
from .language_id import held_out, identify_language
from .license_scan import license_scan
from .license_scan import oracle_sql as license_sql
from .line_quality import ORACLE as LINE_SQL
from .line_quality import line_quality
from .ngram_jaccard import ngram_jaccard_join
from .packing import pack
from .passages import remove_passages
from .ranked_search import oracle_sql as search_sql
from .ranked_search import search
from .repeats import remove_repeats
from .secrets import find_secrets
from .store import table
from .token_files import token_files


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = "transform({}, s -> concat(s.kind, ':', s.start, ':', s.end))"
    base = F.expr("array_join(" + text.format("filter(secrets, s -> s.kind <> 'format')") + ", ',')")
    count = lambda k: F.expr(f"cast(size(filter(secrets, s -> s.kind = '{k}')) as long)").alias(f"n_{k}")
    return found.select("doc_id", *map(count, ("assign", "access", "hex", "format")), F.sha2(base, 256).alias("base_sha256"), F.expr("array_join(" + text.format("secrets") + ", ',')").alias("spans"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify_language(docs).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), with_ids=False)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")


def op11_branch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merge_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return merged.select("doc_id", "lang", "source", F.sha2("text", 256).alias("text_sha256"), "n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_passages(table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_ngram_jaccard_join, op3_line_frequency, op4_language_id, op5_html_text, op6_token_files, op7_best_fit_packing, op8_decontamination, op9_repeated_strings, op10_license_scan, op11_branch_merge, op12_ranked_search, op13_substring_dedup)}

ORACLE_SQL: dict[str, str] = {"op3_line_frequency": LINE_SQL, "op10_license_scan": license_sql(), "op11_branch_merge": merge_sql(), "op12_ranked_search": search_sql()}
