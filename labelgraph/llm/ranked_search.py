"""Ranked lexical search: postings bucketed by term, integer scores, the best documents of each item.

1. Index: (term, row, doc_id, tf, n) of the terms that items ask for, dealt by term and, so
   that a frequent term fills several buckets, by document. One posting without a term a
   document carries its length.
2. Item terms join the postings; each match scores weight * impact in integers, sums
   by item and document are ranked by a window.

Not every match need be made to know the best ``k`` for certain: the terms found in few
documents give each item a least score for place ``k``. An item's terms whose greatest
possible scores together stay below it cannot bring a document in on their own; they are
scored only for documents that its other terms found and that may still reach it.

Terms are compared by 64-bit hashes: an item's score is wrong only if another term of the
corpus shares the hash of one of its terms (about 5e-5 for a million item terms in a
vocabulary of 1e9).

Edge cases: a null, empty or termless text is no document, such an item finds nothing; each row
is a document or an item of its own, also where its id is null (last among equal scores) or
repeated; equal scores rank by doc_id, then by place in the table; empty tables give an empty
result; other columns are not used; texts are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import bounded_batches, written
from .words import PUNCTUATION, Words, chunks, text_buffers

KEEP, SALTS = 10, 16
#: Item terms sent to the tasks that read texts (8 MB); beyond that many, postings meet them in a join.
TERMS_SENT = 1_000_000
#: Rows of weighted item terms joined by broadcast (about 60 MB); beyond that, by shuffle.
ROWS_SENT = 500_000
#: Postings that an item's rarest terms may have together when the first bound is made.
FIRST = 20_000

_SCHEMA = "term long, row long, id long, tf long, n long"


def _postings(texts: DataFrame, wanted: np.ndarray | None) -> DataFrame:
    """(term, row, id, tf, n) of a table (id, text): a row's distinct terms, those ``wanted`` only, and one row with a null term."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column(0)
            off, raw = text_buffers(batch.column(1))
            for lo, hi in chunks(off):
                w = Words(off[lo : hi + 1], raw[off[lo] : off[hi]], PUNCTUATION)
                n = w.counts()
                doc, h = np.repeat(np.arange(hi - lo), n), w.hash
                if wanted is not None and len(h):
                    at = np.minimum(np.searchsorted(wanted, h), max(len(wanted) - 1, 0))
                    keep = wanted[at] == h if len(wanted) else np.zeros(len(h), bool)
                    doc, h = doc[keep], h[keep]
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(new)
                tf = np.diff(np.r_[first, len(h)])
                full = np.flatnonzero(n)
                at = np.r_[doc[first], full]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.r_[h[first].view(np.int64), np.zeros(len(full), np.int64)], mask=np.r_[np.zeros(len(first), bool), np.ones(len(full), bool)]),
                        pa.array(row + lo + at),
                        ids.take(pa.array(lo + at)),
                        pa.array(np.r_[tf, np.zeros(len(full), np.int64)]),
                        pa.array(n[at].astype(np.int64)),
                    ],
                    names=["term", "row", "id", "tf", "n"],
                )
            row += len(batch)

    bounded_batches(texts.sparkSession)
    return texts.mapInArrow(read, _SCHEMA)


def _top(scores: DataFrame, k: int) -> DataFrame:
    """``scores`` with ``rank`` up to k for each item."""
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _least(scores: DataFrame, k: int) -> DataFrame:
    """(item, least): the score at place k of the items that have so many."""
    return _top(scores, k).where(F.col("rank") == k).select("item", F.col("score").alias("least"))


def search(docs: DataFrame, items: DataFrame, k: int = KEEP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents (doc_id, text) of every item (item_id, text)."""
    query = written(_postings(items.select(F.col("item_id").cast("long").alias("id"), "text"), None).where("term is not null").select("term", F.col("row").alias("item"), F.col("id").alias("item_id"), F.col("tf").alias("times")), "item-terms")
    asked = query.select("term").distinct()
    some = asked.limit(TERMS_SENT + 1).count() <= TERMS_SENT
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    found = _postings(texts, np.sort(np.array([r[0] for r in asked.collect()], np.int64).view(np.uint64)) if some else None)
    if not some:
        found = written(found, "all-postings")
        found = found.where("term is null").unionByName(found.join(asked, "term", "left_semi"))
    index = written(found.repartition(F.col("term"), F.col("row") % SALTS).sortWithinPartitions("term", "row"), "postings")

    n_docs, n_terms = index.where("term is null").agg(F.count("*"), F.sum("n")).first()
    length = F.expr(f"25 + 75 * n * {n_docs}L div {n_terms or 1}L")
    index = index.where("term is not null").withColumn("_m", length).withColumn("impact", F.expr("1000000000 * tf div (1000 * tf + 8 * _m)")).select("term", "row", "id", "impact")
    known = index.groupBy("term").agg(F.count("*").alias("df"), F.max("impact").alias("most"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    query = query.join(known, "term").withColumn("weight", F.col("times") * weight).where("weight > 0").withColumn("most", F.col("weight") * F.col("most"))
    query = written(query.select("item", "item_id", "term", "df", "weight", "most"), "weights")
    few = query.limit(ROWS_SENT + 1).count() <= ROWS_SENT

    def summed(terms: DataFrame) -> DataFrame:
        """(item, row, id, score) of all matches of the items' ``terms``."""
        terms = terms.select("item", "term", "weight")
        if few:
            rows = index.join(F.broadcast(terms), "term")
        else:  # a frequent term meets its postings in several tasks
            salted = terms.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
            rows = index.withColumn("salt", F.col("row") % SALTS).join(salted, ["term", "salt"])
        return rows.groupBy("item", "row", "id").agg(F.sum(F.col("weight") * F.col("impact")).alias("score"))

    by = Window.partitionBy("item")
    before = F.sum("df").over(by.orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1))
    rare = query.withColumn("_b", F.coalesce(before, F.lit(0))).where(F.col("_b") < FIRST)
    least = written(_least(summed(rare), k), "least")

    # Terms in order of what they can give at most: those whose running sum stays below the bound bring no document in.
    terms = query.join(least, "item", "left").withColumn("least", F.coalesce("least", F.lit(0)))
    terms = terms.withColumn("_s", F.sum("most").over(by.orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0))).withColumn("leads", F.col("_s") >= F.col("least"))
    terms = written(terms.withColumn("rest", F.max(F.when(~F.col("leads"), F.col("_s"))).over(by)).withColumn("rest", F.coalesce("rest", F.lit(0))), "terms")
    per_item = terms.groupBy("item").agg(F.first("item_id").alias("item_id"), F.first("least").alias("least"), F.first("rest").alias("rest"))
    led = summed(terms.where("leads")).join(per_item, "item").where(F.col("score") + F.col("rest") >= F.col("least"))
    led = written(led, "candidates")

    higher = _least(led.select("item", "row", "id", "score"), k).withColumnRenamed("least", "higher")
    led = led.join(higher, "item", "left").where(F.col("score") + F.col("rest") >= F.coalesce("higher", F.lit(0)))
    more = led.where("rest > 0").select("item", "row").join(terms.where("not leads").select("item", "term", "weight"), "item").join(index.select("term", "row", "impact"), ["term", "row"])
    more = more.groupBy("item", "row").agg(F.sum(F.col("weight") * F.col("impact")).alias("more"))
    scores = led.join(more, ["item", "row"], "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0)))
    best = _top(scores.where("score > 0"), k)
    return best.select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def oracle_sql(k: int = KEEP) -> str:
    """The same as DuckDB SQL, for tables whose ids are distinct."""
    terms = "list_transform(regexp_extract_all(coalesce(text, ''), '[^\\x{00}-\\x{2F}\\x{3A}-\\x{40}\\x{5B}-\\x{60}\\x{7B}-\\x{7F}]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"
    return f"""WITH d AS (SELECT doc_id, {terms} w FROM documents),
p AS (SELECT doc_id, len(w) n, unnest(w) term FROM d),
s AS (SELECT count(*) FILTER (len(w) > 0) nd, sum(len(w))::BIGINT nt FROM d),
i AS (SELECT doc_id, n, term, count(*) tf FROM p GROUP BY ALL),
k AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT w FROM i, s GROUP BY term, nd),
q AS (SELECT item_id, unnest({terms}) term FROM benchmark),
sc AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // nt))))::BIGINT score FROM q JOIN k USING (term) JOIN i USING (term), s GROUP BY 1, 2),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM sc WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {k}"""
