"""A folder of hit files as a stream: the best score of each (query, target) so far.

The engine's analyses are batch queries; only the collecting of hits, which takes hours, is of use as it goes on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crossweave.constants import EVALUE_THRESHOLD
from crossweave.operators.homology import best_hits, usable_hits
from crossweave.sources.schema import HITS


def stream_hits(spark: SparkSession, folder: str, evalue: float = EVALUE_THRESHOLD) -> DataFrame:
    """query, target, bitscore, to be written in update or complete mode."""
    rows = spark.readStream.schema(HITS).option("sep", "\t").csv(folder)
    return best_hits(usable_hits(rows, evalue))
