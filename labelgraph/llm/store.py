"""Tables, shared scratch folders and lineage cuts.

Executors share only the folder the cluster names in ``spark.checkpoint.dir``;
everything an operator writes between its steps goes below it.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where none is set and driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = "file://" + tempfile.mkdtemp(prefix="labelgraph-")
        spark.sparkContext.setCheckpointDir(current)
    return current.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/labelgraph/{what}-{uuid.uuid4().hex}"


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    The shuffle files of the write go as soon as it ends.
    """
    spark = df.sparkSession
    path = scratch(spark, what)
    bounded_batches(spark)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 512) -> None:
    """Whole texts may be long, so fewer of them go to Python at once, unless the session sets its own number.

    Plans read this setting when they run, after the operator has returned, so it stays set.
    """
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, str(rows))


def relieved(spark: SparkSession) -> None:
    """Executors collect their garbage and return the memory, before a step that needs it in Python."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def released(table: DataFrame) -> None:
    """Delete a table that ``written`` made and let Spark drop shuffle files that nothing refers to any more."""
    jvm = table.sparkSession.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    jvm.System.gc()
