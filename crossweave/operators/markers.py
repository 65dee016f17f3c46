"""Marker features of clusters by the Wilcoxon rank-sum test of each cluster against the rest of its dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossweave.functions.numeric import normal_tail_two_sided


def marker_scores(expr: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """species, gene, cluster, z for every feature and cluster of two or more cells; clusters of one cell take no part.

    Values are not negative, so the cells without a row are one block of ties at the bottom: with z of them its
    rank is (z + 1) / 2, and the ranks of the others go up by z. No row is made for a zero. Equal values are counted before
    they are ranked, so that a widespread feature of counts is a few rows."""
    sized = cells.groupBy("species", "cluster").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    part = cells.join(sized.select("species", "cluster"), ["species", "cluster"], "left_semi")
    n = part.groupBy("species").agg(F.count(F.lit(1)).alias("n"))
    rows = expr.filter("value > 0").join(part.select("species", "cell", "cluster"), ["species", "cell"])
    counted = rows.groupBy("species", "gene", "value", "cluster").agg(F.count(F.lit(1)).alias("k"))
    values = counted.groupBy("species", "gene", "value").agg(F.sum("k").alias("t"), F.collect_list(F.struct("cluster", "k")).alias("own"))
    upto = F.sum("t").over(Window.partitionBy("species", "gene").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = values.withColumn("r", upto - (F.col("t") - 1) / 2)
    nnz = values.groupBy("species", "gene").agg(F.sum("t").alias("nnz"))
    sums = ranked.select("species", "gene", "r", F.explode("own").alias("o")).groupBy("species", "gene", "o.cluster").agg(F.sum(F.col("r") * F.col("o.k")).alias("r"), F.sum("o.k").alias("k"))
    grid = genes.select("species", "gene").distinct().join(sized, "species").join(F.broadcast(n), "species")
    full = grid.join(nnz, ["species", "gene"], "left").join(sums, ["species", "gene", "cluster"], "left").na.fill(0, ["nnz", "k"]).na.fill(0.0, ["r"])
    zeros = F.col("n") - F.col("nnz")
    total = F.col("r") + F.col("k") * zeros + (F.col("m") - F.col("k")) * (zeros + 1) / 2
    spread = F.sqrt(F.col("m").cast("double") * (F.col("n") - F.col("m")) * (F.col("n") + 1) / 12)
    z = F.when(spread > 0, (total - F.col("m") * (F.col("n") + 1) / 2.0) / spread).otherwise(F.lit(0.0))
    return full.select("species", "gene", "cluster", z.alias("z"))


def markers(expr: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """species, gene, cluster, score, pval: negative scores become 0 with p 1; clusters of one cell have 0 and 1 throughout."""
    z = marker_scores(expr, cells, genes)
    tested = z.select("species", "gene", "cluster", F.greatest("z", F.lit(0.0)).alias("score"), F.when(F.col("z") < 0, F.lit(1.0)).otherwise(normal_tail_two_sided("z")).alias("pval"))
    alone = cells.groupBy("species", "cluster").agg(F.count(F.lit(1)).alias("m")).filter("m = 1").select("species", "cluster")
    rest = genes.select("species", "gene").distinct().join(alone, "species").select("species", "gene", "cluster", F.lit(0.0).alias("score"), F.lit(1.0).alias("pval"))
    return tested.unionByName(rest)
