"""Cutting lineage with tables that every executor can read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where nothing is set: a local one on a local master, as in tests, else an error."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemark-"))
        known = sc._jsc.sc().getCheckpointDir()
    return known.get()


#: For tables of sorted numbers: differences instead of dictionaries.
PACKED = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false", "compression": "zstd"}


#: Lets Spark delete an execution's shuffle files at its end, not when the driver collects its garbage.
CLEAR = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, packed: bool = False, clear: bool = False) -> DataFrame:
    """Writes `df` as a table into the shared folder and reads it back; the table goes when the application ends, if not discarded before.

    With `clear`, the shuffle files of the write go as soon as it is done.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAR, "false")
    spark.conf.set(CLEAR, "true" if clear else before)
    try:
        df.write.options(**(PACKED if packed else {})).parquet(path)
    finally:
        spark.conf.set(CLEAR, before)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = where
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes settled tables of which nothing will be read again."""
    for t in tables:
        where = getattr(t, "_settled", None)
        if where is not None:
            where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
