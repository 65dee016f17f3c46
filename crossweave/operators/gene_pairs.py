"""Feature pairs that are linked between mapped clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossweave.constants import EXPRESSION_FLOOR, PAIR_LIMIT, PAIR_P_THRESHOLD, WEIGHT_FLOOR
from crossweave.functions.numeric import guarded
from crossweave.functions.text import encode_pair
from crossweave.operators.expression import gene_stats, standardised
from crossweave.operators.markers import markers
from crossweave.operators.scores import mapping_scores
from crossweave.sources.checkpoint import cut


def linked_cells(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """c1, c2, cell, side: the cells of two clusters of different datasets (s1 < s2) with an edge between them, in either direction."""
    one = cells.select(F.col("cell").alias("src"), F.col("species").alias("s1"), F.col("cluster").alias("c1"))
    two = cells.select(F.col("cell").alias("dst"), F.col("species").alias("s2"), F.col("cluster").alias("c2"))
    there, back = F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = edges.select(F.explode(F.array(there, back)).alias("e")).select("e.src", "e.dst")
    met = both.join(one, "src").join(two, "dst").filter("s1 < s2")
    ends = F.array(F.struct(F.col("src").alias("cell"), F.lit(1).alias("side")), F.struct(F.col("dst").alias("cell"), F.lit(2).alias("side")))
    return met.select("c1", "c2", F.explode(ends).alias("e")).select("c1", "c2", "e.cell", "e.side").distinct()


def mapped_clusters(scores: DataFrame, cells: DataFrame, threshold: float, cluster: str | None = None) -> DataFrame:
    """c1, c2, s1, s2: pairs of clusters that reach a mapping score, once each; with ``cluster``, those it is in."""
    species = cells.select("cluster", "species").distinct()
    one, two = (species.select(F.col("cluster").alias(c), F.col("species").alias(s)) for c, s in (("c1", "s1"), ("c2", "s2")))
    pairs = scores.filter(F.col("score") >= threshold).join(one, "c1").join(two, "c2").filter("s1 < s2").select("c1", "c2", "s1", "s2").distinct()
    return pairs if cluster is None else pairs.filter((F.col("c1") == cluster) | (F.col("c2") == cluster))


def pair_scores(clusters: DataFrame, homology: DataFrame, edges: DataFrame, expr: DataFrame, cells: DataFrame, genes: DataFrame, w1t: float = WEIGHT_FLOOR, w2t: float = WEIGHT_FLOOR, expr_thr: float = EXPRESSION_FLOOR) -> DataFrame:
    """c1, c2, g1, g2, score for every homologous pair of each pair of clusters, all in one query.

    A feature's standardised expression is averaged over the linked cells of its cluster; the averages are made
    z-scores over all pairs, negative ones 0; the score is their product over the number of pairs. Pairs with a
    feature that is light or rarely above its mean score 0. Clusters without linked cells give no rows."""
    std = standardised(expr, gene_stats(expr, cells)).select("cell", "gene", "value")
    place = cells.select("cell", "cluster")
    linked = linked_cells(edges, cells).join(clusters.select("c1", "c2"), ["c1", "c2"], "left_semi")
    counts = linked.groupBy("c1", "c2", "side").agg(F.count(F.lit(1)).alias("n"))
    sums = linked.join(std, "cell").groupBy("c1", "c2", "side", "gene").agg(F.sum("value").alias("s"))
    size = place.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"))
    above = std.join(place, "cell").groupBy("cluster", "gene").agg(F.count(F.lit(1)).alias("k")).join(size, "cluster").filter(F.col("k") / F.col("m") > expr_thr).select("cluster", "gene")
    sizes = counts.groupBy("c1", "c2").agg(F.max(F.when(F.col("side") == 1, F.col("n"))).alias("n1"), F.max(F.when(F.col("side") == 2, F.col("n"))).alias("n2"))
    grid = clusters.join(sizes, ["c1", "c2"]).join(homology.select("g1", "g2", "s1", "s2"), ["s1", "s2"])

    def side(k: int, g: str, out: str) -> DataFrame:
        return sums.filter(F.col("side") == k).select("c1", "c2", F.col("gene").alias(g), F.col("s").alias(out))

    full = grid.join(side(1, "g1", "a"), ["c1", "c2", "g1"], "left").join(side(2, "g2", "b"), ["c1", "c2", "g2"], "left").na.fill(0.0, ["a", "b"])
    full = full.withColumns({"a": F.col("a") / F.col("n1"), "b": F.col("b") / F.col("n2")})
    stats = full.groupBy("c1", "c2").agg(F.avg("a").alias("ma"), F.stddev_pop("a").alias("sa"), F.avg("b").alias("mb"), F.stddev_pop("b").alias("sb"), F.count(F.lit(1)).alias("n"))
    z = lambda v, m, s: F.greatest((F.col(v) - F.col(m)) / guarded(F.col(s)), F.lit(0.0))
    rated = full.join(stats, ["c1", "c2"]).withColumn("score", z("a", "ma", "sa") * z("b", "mb", "sb") / F.col("n"))
    heavy = lambda g, t: genes.filter((F.col("weight") >= t) & (F.col("weight") > 0)).select(F.col("gene").alias(g), F.lit(1).alias(f"w_{g}"))
    often = lambda c, g: above.select(F.col("cluster").alias(c), F.col("gene").alias(g), F.lit(1).alias(f"o_{g}"))
    rated = rated.join(heavy("g1", w1t), "g1", "left").join(heavy("g2", w2t), "g2", "left").join(often("c1", "g1"), ["c1", "g1"], "left").join(often("c2", "g2"), ["c2", "g2"], "left")
    every = F.col("w_g1").isNotNull() & F.col("w_g2").isNotNull() & F.col("o_g1").isNotNull() & F.col("o_g2").isNotNull()
    return rated.select("c1", "c2", "g1", "g2", F.when(every, F.col("score")).otherwise(F.lit(0.0)).alias("score"))


def find_genes(scores: DataFrame, tested: DataFrame, n_genes: int = PAIR_LIMIT, thr: float = PAIR_P_THRESHOLD) -> DataFrame:
    """c1, c2, pair, g1, g2, rank, p1, p2: the n best pairs of each pair of clusters whose features are markers of their clusters (``tested``: gene, cluster, pval)."""
    order = Window.partitionBy("c1", "c2").orderBy(F.desc(F.round("score", 12)), "g1", "g2")
    best = scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n_genes)
    one, two = (tested.select(F.col("cluster").alias(c), F.col("gene").alias(g), F.col("pval").alias(p)) for c, g, p in (("c1", "g1", "p1"), ("c2", "g2", "p2")))
    kept = best.join(one, ["c1", "g1"]).join(two, ["c2", "g2"]).filter((F.col("p1") < thr) & (F.col("p2") < thr))
    return kept.select("c1", "c2", encode_pair(F.col("g1"), F.col("g2")).alias("pair"), "g1", "g2", "rank", "score", "p1", "p2")


def unique_genes(found: DataFrame, side: str = "g1") -> DataFrame:
    """c1, c2, gene, rank: each feature once, where it first comes."""
    return found.groupBy("c1", "c2", F.col(side).alias("gene")).agg(F.min("rank").alias("rank"))


class GenePairFinder:
    """Linked feature pairs of a finished mapping; markers are computed once, as a table in the checkpoint folder."""

    def __init__(self, edges: DataFrame, homology: DataFrame, expr: DataFrame, cells: DataFrame, genes: DataFrame, scores: DataFrame, k: float = 1.0) -> None:
        """``scores``: of all cells, over k."""
        self.edges, self.homology, self.expr, self.cells, self.genes, self.scores, self.k = edges, homology, expr, cells, genes, scores, k
        self._markers: DataFrame | None = None

    @property
    def markers(self) -> DataFrame:
        if self._markers is None:
            self._markers = cut(markers(self.expr, self.cells, self.genes))
        return self._markers

    def pair_scores(self, align_thr: float = 0.1, w1t: float = WEIGHT_FLOOR, w2t: float = WEIGHT_FLOOR) -> DataFrame:
        """The scores of all homologous pairs of all mapped pairs of clusters."""
        return pair_scores(mapped_clusters(self.scores, self.cells, align_thr), self.homology, self.edges, self.expr, self.cells, self.genes, w1t, w2t)

    def find_genes(self, c1: str, c2: str, w1t: float = WEIGHT_FLOOR, w2t: float = WEIGHT_FLOOR, n_genes: int = PAIR_LIMIT, thr: float = PAIR_P_THRESHOLD) -> DataFrame:
        """The pairs of two clusters, named in either order."""
        pairs = mapped_clusters(self.scores, self.cells, 0.0).filter(F.array_sort(F.array("c1", "c2")) == F.array(*map(F.lit, sorted((c1, c2)))))
        return self._find(pairs, w1t, w2t, n_genes, thr)

    def find_all(self, cluster: str | None = None, align_thr: float = 0.1, w1t: float = WEIGHT_FLOOR, w2t: float = WEIGHT_FLOOR, n_genes: int = PAIR_LIMIT, thr: float = PAIR_P_THRESHOLD, n_top: int = 0) -> DataFrame:
        """The pairs of all mapped clusters, in long form; with ``n_top``, clusters are mapped by that many of their best cells."""
        found = mapping_scores(self.edges, self.cells, n_top, self.k) if n_top else self.scores
        return self._find(mapped_clusters(found, self.cells, align_thr, cluster), w1t, w2t, n_genes, thr)

    def _find(self, pairs: DataFrame, w1t: float, w2t: float, n_genes: int, thr: float) -> DataFrame:
        return find_genes(pair_scores(pairs, self.homology, self.edges, self.expr, self.cells, self.genes, w1t, w2t), self.markers, n_genes, thr)
