"""What the corpus operators share: table access, checkpoints, Arrow maps."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Fixed value: ASCII white space, the separators of words in every contract here.
WORD_SEPARATORS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table, read by Spark only (any store that Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; only a session on one machine may have none, and gets a local one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="crossweave-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there: computed once, safe from lost executors."""
    with_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of texts that a worker turns into Python strings at once.
TEXT_ROWS = 500


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows (an empty one stays), without copies."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)


def give_back() -> None:
    """Return freed memory to the system, where the C library can (glibc keeps it otherwise)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, rows: int | None = None) -> DataFrame:
    """``mapInArrow`` by a function over the batches of a partition, in parts of ``rows`` for functions over texts.

    Workers live on between tasks, so each task gives back what it has freed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches if rows is None else slices(batches, rows))
        give_back()

    return df.mapInArrow(run, schema)


def texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Whole texts, with null read as empty."""
    return [x or "" for x in column.to_pylist()]


def partitions(spark: SparkSession) -> int:
    """How many partitions this session deals its shuffles over."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(name: str, taken: list[str]) -> str:
    """A column name like ``name`` that none of the taken ones is."""
    known = {x.lower() for x in taken}
    while name.lower() in known:
        name += "_"
    return name


#: Tables that this process has stored and not removed.
_stored: list[str] = []


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back: compact, and safe from lost executors."""
    spark = df.sparkSession
    with_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/crossweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stored.append(path)
    return spark.read.schema(df.schema).parquet(path)


def stored() -> int:
    """How many stored tables there are: what ``release`` takes to leave them alone."""
    return len(_stored)


def release(spark: SparkSession, since: int = 0) -> None:
    """Remove the tables stored since then, which the caller knows that nothing will read again."""
    for path in _stored[since:]:
        remove(spark, path)
    del _stored[since:]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
