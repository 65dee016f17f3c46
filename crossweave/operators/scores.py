"""Mapping scores between clusters of different datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossweave.sources.checkpoint import cut


def directed(edges: DataFrame, cells: DataFrame, n_top: int = 0) -> DataFrame:
    """c1, c2, score: mean weight that the cells of c1 send into c2 of another dataset, over all cells of c1, or over the n_top best of each c2."""
    one = cells.select(F.col("cell").alias("src"), F.col("species").alias("__s1"), F.col("cluster").alias("c1"))
    two = cells.select(F.col("cell").alias("dst"), F.col("species").alias("__s2"), F.col("cluster").alias("c2"))
    sums = edges.join(one, "src").join(two, "dst").filter("__s1 <> __s2").groupBy("src", "c1", "c2").agg(F.sum("weight").alias("w"))
    size = cells.groupBy(F.col("cluster").alias("c1")).agg(F.count(F.lit(1)).alias("n"))
    if n_top:
        order = Window.partitionBy("c1", "c2").orderBy(F.desc("w"), "src")
        sums = sums.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= n_top)
        size = size.select("c1", F.least(F.col("n"), F.lit(n_top)).alias("n"))
    return sums.groupBy("c1", "c2").agg(F.sum("w").alias("s")).join(size, "c1").select("c1", "c2", (F.col("s") / F.col("n")).alias("score"))


def mapping_scores(edges: DataFrame, cells: DataFrame, n_top: int = 0, k: float = 1.0) -> DataFrame:
    """c1, c2, score on the whole grid of clusters: the larger of the two directions over k, 0 without edges."""
    s = directed(edges, cells, n_top)
    there, back = F.struct("c1", "c2"), F.struct(F.col("c2").alias("c1"), F.col("c1").alias("c2"))
    either = s.select(F.explode(F.array(there, back)).alias("p"), "score").groupBy("p.c1", "p.c2").agg(F.max("score").alias("score"))
    names = cells.select(F.col("cluster").alias("c1")).distinct()
    grid = names.join(F.broadcast(names.select(F.col("c1").alias("c2"))))  # cluster labels, not cells
    return grid.join(either, ["c1", "c2"], "left").select("c1", "c2", (F.coalesce("score", F.lit(0.0)) / k).alias("score"))


def ranked(scores: DataFrame) -> DataFrame:
    """anchor, anchor_rank, rank, cluster, score: anchors by their best score, partners by theirs; ties by name."""
    scores = cut(scores)  # clusters by clusters, read twice
    best = scores.groupBy("c1").agg(F.max("score").alias("best"))
    anchors = best.select("c1", F.row_number().over(Window.orderBy(F.desc("best"), "c1")).alias("anchor_rank"))  # clusters only
    order = Window.partitionBy("c1").orderBy(F.desc("score"), "c2")
    return scores.withColumn("rank", F.row_number().over(order)).join(anchors, "c1").select(F.col("c1").alias("anchor"), "anchor_rank", "rank", F.col("c2").alias("cluster"), "score")
