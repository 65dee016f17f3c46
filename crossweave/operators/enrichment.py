"""Over-represented gene sets by the hypergeometric test."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossweave.constants import FDR_THRESHOLD, P_THRESHOLD
from crossweave.functions.numeric import ln_factorial, neg_log10
from crossweave.functions.text import qualify, unpack
from crossweave.sources.checkpoint import cut


def sets_from(annotations: DataFrame, delimiter: str = "") -> DataFrame:
    """term, gene: the distinct sets of packed annotations(species, gene, packed)."""
    rows = annotations.filter(F.col("packed").isNotNull() & (F.col("packed") != "nan"))
    return rows.select(F.explode(unpack(F.col("packed"), delimiter)).alias("term"), qualify(F.col("gene"), F.col("species")).alias("gene")).distinct()


def annotated(genes: DataFrame, annotations: DataFrame) -> DataFrame:
    """species, gene, packed for every feature of genes(species, gene): its packed annotation, empty where it has none."""
    known = annotations.select("species", qualify(F.col("gene"), F.col("species")).alias("gene"), "packed")
    return genes.select("species", "gene").distinct().join(known, ["species", "gene"], "left").select("species", "gene", F.coalesce("packed", F.lit("")).alias("packed"))


def tested(targets: DataFrame, sets: DataFrame) -> DataFrame:
    """node, term, n_overlap, p, genes: for each node's targets(node, gene), every term that shares a gene with them.

    p is the chance of as many or more of the term's genes among as many draws from all genes of the sets. Genes
    count once for a term."""
    sets = sets.select("term", "gene").distinct()
    background = sets.select("gene").distinct()
    n_all = background.count()
    hit = targets.select("node", "gene").distinct().join(background, "gene", "left_semi")
    n_target = hit.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    size = sets.groupBy("term").agg(F.count(F.lit(1)).alias("m"))
    overlap = hit.join(sets, "gene").groupBy("node", "term").agg(F.count(F.lit(1)).alias("b"), F.array_join(F.array_sort(F.collect_set("gene")), ";").alias("genes"))
    cases = overlap.join(n_target, "node").join(size, "term").withColumn("x", F.explode(F.sequence("b", F.least("n", "m"))))
    cases = cases.filter(F.col("n") - F.col("x") <= n_all - F.col("m"))

    n, m, x, total = F.col("n"), F.col("m"), F.col("x"), F.lit(n_all)
    plus = (m, total - m, n, total - n)
    minus = (x, m - x, n - x, total - m - n + x, total)
    log_p = sum(map(ln_factorial, plus), F.lit(0.0)) - sum(map(ln_factorial, minus), F.lit(0.0))
    return cases.groupBy("node", "term", "b", "genes").agg(F.sum(F.exp(log_p)).alias("p")).select("node", "term", F.col("b").alias("n_overlap"), F.least("p", F.lit(1.0)).alias("p"), "genes")


def go_enrichment(targets: DataFrame, sets: DataFrame, fdr: float | None = FDR_THRESHOLD, p: float | None = P_THRESHOLD) -> DataFrame:
    """node, term, n_overlap, p, q, rank, genes: q = p · m / rank, with the rank of p among the node's m terms; below both thresholds.

    Rank is the order of the results of a node. Values of p that differ by rounding alone are ties, which go by term."""
    rows = tested(targets, sets)
    by_node = Window.partitionBy("node")
    order = F.round(F.log(F.greatest("p", F.lit(1e-300))), 9)
    rated = rows.withColumn("rank", F.row_number().over(by_node.orderBy(order, "term"))).withColumn("q", F.col("p") * F.count(F.lit(1)).over(by_node) / F.col("rank"))
    kept = rated if fdr is None else rated.filter(F.col("q") < fdr)
    return (kept if p is None else kept.filter(F.col("p") < p)).select("node", "term", "n_overlap", "p", "q", "rank", "genes")


class FunctionalEnrichment:
    """Enrichment of the linked features of every cluster."""

    def __init__(self, found: DataFrame, sets: DataFrame, limit_reference: bool = False, skip: tuple[str, ...] = ("S",)) -> None:
        """``found``: the pairs of ``GenePairFinder.find_all``; ``limit_reference``: only genes of some pair are the background."""
        found = cut(found.select("c1", "c2", "g1", "g2"))
        one = found.select(F.col("c1").alias("node"), F.col("g1").alias("gene"))
        # Read several times, and far smaller than what it takes to find them.
        self.targets = cut(one.unionByName(found.select(F.col("c2").alias("node"), F.col("g2").alias("gene"))).distinct())
        self.sets = sets.join(self.targets.select("gene").distinct(), "gene", "left_semi") if limit_reference else sets
        self.skip = skip

    def calculate(self) -> DataFrame:
        """node, term, enrichment (-log10 p), n_genes, genes in long form, without thresholds."""
        rows = go_enrichment(self.targets, self.sets, None, None).filter(~F.col("term").isin(list(self.skip)))
        return rows.select("node", "term", neg_log10(F.col("p")).alias("enrichment"), F.col("n_overlap").alias("n_genes"), "genes")

    def matrix(self, value: str = "enrichment") -> DataFrame:
        """One column for each term; for display, so the number of terms is small."""
        terms = [r["term"] for r in self.calculate().select("term").distinct().orderBy("term").collect()]
        return self.calculate().groupBy("node").pivot("term", terms).agg(F.first(value))

    def plot_data(self, nodes: list[str] | None = None, least: float = 2.0) -> DataFrame:
        """node, term, enrichment, n_genes, genes, node_at, term_at: what an enrichment plot shows, with both sides in the order of Ward's clustering.

        Values under ``least`` count as 0. For display, so nodes and terms are ``MOST_SHOWN`` each at most."""
        rows = cut(self.calculate() if nodes is None else self.calculate().filter(F.col("node").isin(nodes)))
        ends = [[r[0] for r in rows.select(c).distinct().orderBy(c).limit(MOST_SHOWN + 1).collect()] for c in ("node", "term")]
        if any(len(x) > MOST_SHOWN for x in ends):
            raise ValueError(f"a plot shows {MOST_SHOWN} nodes and terms at most")
        strong = rows.filter(F.col("enrichment") >= least)
        shown = np.zeros(tuple(map(len, ends)))
        at = [{name: i for i, name in enumerate(x)} for x in ends]
        for r in strong.select("node", "term", "enrichment").collect():
            shown[at[0][r["node"]], at[1][r["term"]]] = r["enrichment"]
        spark = rows.sparkSession
        orders = (spark.createDataFrame([(x[i], k) for k, i in enumerate(ward_order(m))], f"{c} string, {c}_at int") for x, m, c in zip(ends, (shown, shown.T), ("node", "term")))
        order, terms = orders
        grid = F.broadcast(order).join(F.broadcast(terms))  # what is shown, whose size is checked above
        return grid.join(strong, ["node", "term"], "left").na.fill(0.0, ["enrichment"]).na.fill(0, ["n_genes"]).na.fill("", ["genes"]).select("node", "term", "enrichment", "n_genes", "genes", "node_at", "term_at")


MOST_SHOWN = 1_000


def ward_order(points: np.ndarray) -> list[int]:
    """Leaves of Ward's clustering of rows from left to right: at each merge the cluster that is older comes first."""
    n = len(points)
    if n == 0:
        return []
    # Twice the growth of the squared deviations if two clusters are merged; merged clusters take the place of their first part.
    apart = ((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2) if n * n * points.shape[1] < 1 << 24 else np.array([((points - p) ** 2).sum(axis=1) for p in points])
    np.fill_diagonal(apart, np.inf)
    sizes, age, leaves = np.ones(n), list(range(n)), [[i] for i in range(n)]
    for made in range(n, 2 * n - 1):
        i, j = sorted(divmod(int(np.argmin(apart)), n), key=lambda k: age[k])
        s = sizes
        merged = ((s[i] + s) * apart[i] + (s[j] + s) * apart[j] - s * apart[i, j]) / (s[i] + s[j] + s)
        sizes = s.copy()
        sizes[i] += s[j]
        leaves[i] += leaves[j]
        age[i] = made
        merged[[i, j]] = np.inf
        merged[~np.isfinite(apart[i]) & ~np.isfinite(apart[j])] = np.inf
        apart[i], apart[:, i] = merged, merged
        apart[j], apart[:, j] = np.inf, np.inf
    return leaves[int(np.argmax(sizes))]
