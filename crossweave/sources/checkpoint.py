"""Cutting lineage in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _directory(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; only a session on one machine may have none, and gets a local one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="crossweave-"))
    return context.getCheckpointDir()


def folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder, for tables."""
    return f"{_directory(spark)}/crossweave-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Compute once, as a table in the shared folder, and go on from there.

    Unlike after ``checkpoint()``, Spark knows the table's size, where estimates that are carried along would be
    multiplied by every join of a loop."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
