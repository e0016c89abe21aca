"""Folders for what is written to be read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """A new path in the shared folder of spark.checkpoint.dir (on a local master without one, in a local folder), gone when the application ends."""
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    top = spark.conf.get("spark.checkpoint.dir", None) or (None if known.isEmpty() else known.get())
    if top is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="tidemark-")
    path = f"{top.rstrip('/')}/files-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path
