"""Tables behind the drawings: links between mapped clusters, and overlap of expression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossweave.constants import ALIGNMENT_THRESHOLD
from crossweave.functions.numeric import guarded
from crossweave.functions.text import species_of


def sankey_links(scores: DataFrame, order: list[str] | None = None, threshold: float = ALIGNMENT_THRESHOLD) -> DataFrame:
    """source, target, value: each mapped pair once, between datasets that are next to each other in the order, the earlier first."""
    strong = scores.filter((F.col("score") >= threshold) & (F.col("c1") < F.col("c2")))
    s1, s2 = species_of(F.col("c1")), species_of(F.col("c2"))
    if not order:
        return strong.filter(s1 != s2).select(F.col("c1").alias("source"), F.col("c2").alias("target"), F.col("score").alias("value"))
    at = lambda s: F.array_position(F.array(*map(F.lit, order)), s)
    rated = strong.withColumns({"__a": at(s1), "__b": at(s2)}).filter((F.col("__a") > 0) & (F.col("__b") > 0))
    near = rated.filter(F.abs(F.col("__a") - F.col("__b")) == 1)
    forward = F.col("__a") < F.col("__b")
    return near.select(F.when(forward, F.col("c1")).otherwise(F.col("c2")).alias("source"), F.when(forward, F.col("c2")).otherwise(F.col("c1")).alias("target"), F.col("score").alias("value"))


def expression_overlap(graph: DataFrame, expr: DataFrame, genes: dict[str, str], threshold: float = 0.1) -> DataFrame:
    """cell, <dataset> ..., overlap: neighbour-averaged expression of one feature of each dataset, and the least of them, over its largest.

    Values below the threshold are 0; cells with none above have no row."""
    row = graph.groupBy("src").agg(F.sum("weight").alias("t"))
    wanted = expr.filter(F.col("gene").isin(list(genes.values()))).select(F.col("cell").alias("dst"), "gene", "value")
    mean = graph.join(wanted, "dst").groupBy("src", "gene").agg(F.sum(F.col("weight") * F.col("value")).alias("s")).join(row, "src")
    rated = mean.select(F.col("src").alias("cell"), "gene", (F.col("s") / guarded(F.col("t"))).alias("v"))
    per = [F.coalesce(F.max(F.when(F.col("gene") == g, F.col("v"))), F.lit(0.0)).alias(s) for s, g in genes.items()]
    wide = rated.groupBy("cell").agg(*per)
    for s in genes:
        wide = wide.withColumn(s, F.when(F.col(s) < threshold, F.lit(0.0)).otherwise(F.col(s)))
    least = F.least(*genes) if len(genes) > 1 else F.col(next(iter(genes)))
    wide = wide.withColumn("overlap", least).filter(F.greatest(*genes, F.lit(0.0)) > 0)
    most = wide.agg(F.max("overlap").alias("__most"))
    return wide.join(F.broadcast(most)).select("cell", *genes, (F.col("overlap") / guarded(F.col("__most"))).alias("overlap"))  # one row
