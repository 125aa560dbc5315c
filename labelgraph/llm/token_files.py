"""Token ids as binary shards in ascending doc_id order, and reading them back.

Texts are dealt by ranges of doc_id; each task encodes its range, writes its
shards (see rans.py) below ``path`` and reports them. The manifest, a table
written by Spark, names just the shards of tasks that succeeded, so retried or
lost tasks leave nothing that is read. Shards hold about ``SHARD`` bytes of text,
and never over twice as much but for their last text.

Edge cases: null or empty text is its end id alone; a null doc_id is kept as
the least long and returned as null, first; repeated doc_ids follow each other;
an empty table gives no shard and an empty result; other columns are not used; a
long text is one document of one shard, which is then as large as it.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rans import pack_shard, unpack_shard
from .store import bounded_batches, scratch
from .tokens import encoder

SHARD = 16 << 20
#: Tasks that write or read at most; beyond that each takes several shards, one after the other.
TASKS = 20_000
END = 0
_NULL = -(1 << 63)


def write_token_files(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", tokenizer_path: str | None = None, end: int = END, shard: int = SHARD) -> DataFrame:
    """Write the shards of ``docs`` (doc_id, text) below ``path``; returns the manifest (task, part, file, docs, ids, bytes)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    last = int(end).to_bytes(4, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, doc_ids, ids, held, part = encoder(tokenizer, tokenizer_path), [], [], 0, 0
        task = TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(x) // 4 for x in ids])
            data = pack_shard(np.array([_NULL if d is None else d for d in doc_ids], np.int64), lengths, np.frombuffer(b"".join(ids), "<u4"))
            store, root = fs.FileSystem.from_uri(path)
            store.create_dir(root, recursive=True)
            name = f"shard-{task:08d}-{part:08d}-{uuid.uuid4().hex}.lgr"
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(data)
            row = (task, part, name, len(doc_ids), int(lengths.sum()), len(data))
            doc_ids.clear()
            ids.clear()
            return pa.RecordBatch.from_pydict({c: [x] for c, x in zip(("task", "part", "file", "docs", "ids", "bytes"), row, strict=True)})

        for batch in batches:
            for lo in range(0, len(batch), 512):
                some = batch.slice(lo, 512)
                texts = some.column(1).to_pylist()
                for d, t, x in zip(some.column(0).to_pylist(), texts, e.encode(texts), strict=True):
                    doc_ids.append(d)
                    ids.append(x + last)
                    held += len(t or "")
                    if held >= 2 * shard:  # ranges are estimates, so one may hold far more than its share
                        yield flush()
                        held, part = 0, part + 1
        if doc_ids:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(min(max(1, -(-size // shard)), TASKS), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(write, "task long, part long, file string, docs long, ids long, bytes long").write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def starts(manifest: DataFrame, block: int = 64) -> DataFrame:
    """(before, file): the ids of all shards before each, as sums within blocks of tasks and sums of blocks.

    One task sums the blocks: at most ``TASKS`` / ``block`` rows.
    """
    m = manifest.select("task", "part", "file", "ids", F.floor(F.col("task") / block).alias("block"))
    earlier = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = m.groupBy("block").agg(F.sum("ids").alias("all")).select("block", earlier(Window.orderBy("block"), "all").alias("base"))
    inner = m.withColumn("inner", earlier(Window.partitionBy("block").orderBy("task", "part"), "ids"))
    return inner.join(blocks, "block").select((F.col("base") + F.col("inner")).alias("before"), "file")


def read_token_files(manifest: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the shards; start counts the ids before it in all.

    Without ``with_ids`` the ids are decoded and checked but not returned.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for base, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_stream(f"{root}/{name}") as f:
                    doc_ids, lengths, ids = unpack_shard(f.read())
                at = np.r_[0, np.cumsum(lengths, dtype=np.int64)]
                for lo in range(0, len(doc_ids), 2048):
                    hi = min(lo + 2048, len(doc_ids))
                    crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[lo:hi], at[lo + 1 : hi + 1], strict=True)]
                    d = doc_ids[lo:hi]
                    cols = {"doc_id": pa.array(d, pa.int64(), mask=d == _NULL), "start": pa.array(base + at[lo:hi]), "n_tokens": pa.array(lengths[lo:hi].astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64())}
                    if with_ids:
                        cols["ids"] = pa.ListArray.from_arrays(pa.array((at[lo : hi + 1] - at[lo]).astype(np.int32)), pa.array(ids[at[lo] : at[hi]].astype(np.int32)))
                    yield pa.RecordBatch.from_pydict(cols)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    shards = manifest.count()
    return starts(manifest).repartition(min(max(1, shards), TASKS)).mapInArrow(read, schema)


def token_files(docs: DataFrame, path: str | None = None, with_ids: bool = True, **options) -> DataFrame:
    """Write, then read back."""
    path = path or scratch(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, path, **options), path, with_ids)
