"""Stitching: from neighbours across datasets to one graph over all cells.

Graphs are (src, dst, weight); ``cells(cell, species, cluster)`` tells where a cell belongs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossweave.functions.numeric import floored, guarded, tanh_scale
from crossweave.operators.linalg import by_row_max


def rings(graph: DataFrame, hops: int) -> DataFrame:
    """src, dst, ring, weight: ring 0 is the graph itself; ring r has the (r+1)-step weights to cells of no earlier ring."""
    step = graph.select("src", "dst", "weight")
    walk, out = step, step.withColumn("ring", F.lit(0))
    for ring in range(1, hops + 1):
        onward = step.select(F.col("src").alias("dst"), F.col("dst").alias("to"), F.col("weight").alias("w"))
        walk = walk.join(onward, "dst").groupBy("src", F.col("to").alias("dst")).agg(F.sum(F.col("weight") * F.col("w")).alias("weight"))
        fresh = walk.join(out.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("ring", F.lit(ring))
        out = out.unionByName(fresh)
    return out


def neighbourhoods(graph: DataFrame, cells: DataFrame, hops: int) -> DataFrame:
    """src, dst: the nearest cells by ring, then weight, as many as the cell's own cluster has cells.

    One ranking over all rings equals top-k by ring with what is left of the budget."""
    size = cells.groupBy("species", "cluster").agg(F.count(F.lit(1)).alias("k"))
    budget = cells.join(size, ["species", "cluster"]).select(F.col("cell").alias("src"), "k")
    order = Window.partitionBy("src").orderBy("ring", F.desc(F.round("weight", 12)), "dst")
    ranked = rings(graph, hops).withColumn("__rank", F.row_number().over(order))
    return ranked.join(budget, "src").filter("__rank <= k").select("src", "dst")


def coarsened(knn: DataFrame, neighbourhood: DataFrame, least: float = 0.1) -> DataFrame:
    """src, dst, weight: the weight a cell sends into the neighbourhood of another; small sums are left out (sums that differ from
    ``least`` by their order of summation alone aren't)."""
    into = neighbourhood.select(F.col("dst").alias("member"), F.col("src").alias("to"))
    sums = knn.join(into, knn["dst"] == into["member"]).groupBy("src", F.col("to").alias("dst")).agg(F.sum("weight").alias("weight"))
    return sums.filter(F.col("weight") >= least - 1e-9)


def coclustered(knn: DataFrame, cells: DataFrame) -> DataFrame:
    """As ``coarsened`` with a cell's whole cluster for its neighbourhood; nothing is left out.

    Weights are summed by cluster before they go to its members."""
    where = cells.select(F.col("cell").alias("dst"), "species", "cluster")
    sums = knn.join(where, "dst").groupBy("src", "species", "cluster").agg(F.sum("weight").alias("weight"))
    return sums.join(where, ["species", "cluster"]).select("src", "dst", "weight")


def mutual(sent: DataFrame) -> DataFrame:
    """sqrt(w[i,j] · w[j,i]) where both exist."""
    a, b = F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    there = F.max(F.when(F.col("src") <= F.col("dst"), F.col("weight"))).alias("x")
    back = F.max(F.when(F.col("src") >= F.col("dst"), F.col("weight"))).alias("y")
    # One pass by unordered pair instead of a join of the table with itself.
    met = sent.groupBy(a, b).agg(there, back).filter("x IS NOT NULL AND y IS NOT NULL")
    ends = F.array_distinct(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    return met.select(F.explode(ends).alias("e"), F.sqrt(F.col("x") * F.col("y")).alias("weight")).select("e.src", "e.dst", "weight")


def _pearson(x, y):
    n = F.size(x).cast("double")
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / n
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    cov = dot(x, y) / n - mean(x) * mean(y)
    spread = (dot(x, x) / n - mean(x) * mean(x)) * (dot(y, y) / n - mean(y) * mean(y))
    return F.when(spread > 0, cov / F.sqrt(spread))


def edge_correlations(edges: DataFrame, latent: DataFrame) -> DataFrame:
    """src, dst, corr: Pearson correlation of the ends' vectors; null where a vector doesn't vary."""
    one = latent.select(F.col("cell").alias("src"), F.col("vec").cast("array<double>").alias("__x"))
    two = latent.select(F.col("cell").alias("dst"), F.col("vec").cast("array<double>").alias("__y"))
    return edges.join(one, "src").join(two, "dst").withColumn("corr", _pearson(F.col("__x"), F.col("__y"))).drop("__x", "__y")


def rescaled(edges: DataFrame, latent: DataFrame) -> DataFrame:
    """Weights joined by geometric mean with the shaped correlation of the ends; each row keeps its largest weight."""
    row = Window.partitionBy("src")
    rated = edge_correlations(edges, latent).withColumn("f", floored(F.col("corr")))
    rated = by_row_max(rated, "src", value="f").withColumn("f", tanh_scale(F.col("f"), 10.0, 0.7))
    rated = rated.withColumn("e", F.sqrt(F.col("f") * F.col("weight")))
    factor = F.max("weight").over(row) / guarded(F.max("e").over(row))
    return rated.withColumn("weight", F.col("e") * factor).select("src", "dst", "weight")


def strongest(edges: DataFrame, cells: DataFrame, k: int, pairwise: bool = True) -> DataFrame:
    """src, dst, weight: the k largest of a row, for each other dataset if there are more than two and ``pairwise``."""
    species = cells.select(F.col("cell").alias("dst"), F.col("species").alias("dst_species"))
    several = pairwise and cells.select("species").distinct().count() > 2
    order = Window.partitionBy("src", *(["dst_species"] if several else [])).orderBy(F.desc(F.round("weight", 12)), "dst")
    return edges.join(species, "dst").withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= k).select("src", "dst", "weight")


def stitched(across: DataFrame, graph: DataFrame, cells: DataFrame, k: int, pairwise: bool = True) -> DataFrame:
    """src, dst, weight: the edges across datasets, and each cell's own neighbours with what its edges leave of 1."""
    n = cells.select("species").distinct().count()
    most = k * (n - 1) if pairwise and n > 2 else k
    used = across.groupBy("src").agg(F.sum("weight").alias("__used"))
    inner = graph.select("src", "dst").filter("src <> dst").join(used, "src", "left").select("src", "dst", (1 - F.coalesce("__used", F.lit(0.0)) / most).alias("weight"))
    return across.select("src", "dst", "weight").filter("src <> dst").unionByName(inner).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def alignment_means(edges: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """s1, s2, weight: the mean, over the cells of s1, of their weights to s2, over k; 0 within a dataset."""
    counts = cells.groupBy("species").agg(F.count(F.lit(1)).alias("n"))
    one, two = (cells.select(F.col("cell").alias(c), F.col("species").alias(s)) for c, s in (("src", "s1"), ("dst", "s2")))
    sums = edges.join(one, "src").join(two, "dst").filter("s1 <> s2").groupBy("s1", "s2").agg(F.sum("weight").alias("w"))
    grid = counts.select(F.col("species").alias("s1"), "n").join(F.broadcast(counts.select(F.col("species").alias("s2"))))  # datasets only
    return grid.join(sums, ["s1", "s2"], "left").select("s1", "s2", (F.coalesce("w", F.lit(0.0)) / F.col("n") / k).alias("weight"))
