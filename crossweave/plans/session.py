"""The mapping session: several datasets, their homology, and the loop that stitches them into one graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave import constants
from crossweave.exceptions import DataError, MappingError, SpeciesNotFoundError
from crossweave.functions.numeric import tanh_scale
from crossweave.functions.text import qualify
from crossweave.log import get_logger
from crossweave.operators import expression, homology, knn, latent, paralogs, refine, scores, stitch, triangles
from crossweave.operators.enrichment import FunctionalEnrichment, sets_from
from crossweave.operators.gene_pairs import GenePairFinder
from crossweave.sources import hits, store
from crossweave.sources.checkpoint import cut
from crossweave.sources.schema import checked

log = get_logger("session")


class Mapping:
    """Tables of all datasets in one place; ``run`` fills ``knn``, ``latent``, ``edges``, ``graph`` and ``refined``.

    ``loadings`` has a species column and numbers its components within each dataset; without it they are computed.
    Without any homology the datasets share their features. Tables are cut in the shared checkpoint folder after
    each stage, so that lineage doesn't grow with the iterations."""

    def __init__(
        self,
        expr: DataFrame,
        cells: DataFrame,
        genes: DataFrame,
        graph: DataFrame,
        loadings: DataFrame | None = None,
        edges: DataFrame | None = None,
        hit_folder: str | None = None,
        names: DataFrame | None = None,
        evalue: float = constants.EVALUE_THRESHOLD,
        prune_share: float = constants.PRUNE_THRESHOLD,
        components: int = constants.COMPONENTS,
    ) -> None:
        self.expr, self.cells, self.genes, self.cell_graph = checked(expr, "expr"), checked(cells, "cells"), checked(genes, "genes"), checked(graph, "graph")
        self.spark: SparkSession = expr.sparkSession
        self.species = sorted(r["species"] for r in self.cells.select("species").distinct().collect())
        if any("_" in s for s in self.species):
            raise DataError("a dataset id can't have an underscore")
        if loadings is None:
            loadings = expression.components(self.expr, self.cells, self.genes, components)
        self.loadings = checked(loadings, "loadings")
        if "species" not in self.loadings.columns:
            raise DataError("loadings: no column species")
        if edges is None and hit_folder is not None:
            edges = hits.read_homology(self.spark, hit_folder, self.species, evalue)
        if edges is not None:
            # The graph's features have their dataset's id before their names; without a graph, equal names are shared features.
            self.expr, self.genes, self.loadings = (t.withColumn("gene", qualify(F.col("gene"), F.col("species"))) for t in (self.expr, self.genes, self.loadings))
            edges = checked(edges, "homology")
            if names is not None:
                edges = homology.coarsen(edges, checked(names, "names"))
            edges = cut(homology.present(homology.prune(edges, prune_share), self.genes))
        # Read by many steps of every pass, so computed once.
        self.expr, self.cells, self.genes, self.loadings, self.cell_graph = map(cut, (self.expr, self.cells, self.genes, self.loadings, self.cell_graph))
        self.homology = edges
        self.refined: DataFrame | None = None
        self.history: list[DataFrame] = []
        self.knn = self.latent = self.edges = self.graph = self.packed = None
        self.k = constants.NEIGHBOURS

    def _joint(self) -> DataFrame:
        """cell, species, vec: all cells in the components of all datasets."""
        order = F.array_position(F.array(*map(F.lit, self.species)), F.col("species")) - 1
        width = (self.loadings.agg(F.max("pc")).first()[0] or 0) + 1
        joint = self.loadings.select("gene", (order * width + F.col("pc")).cast("int").alias("pc"), "value")
        if self.homology is not None and self.genes.count() <= latent.MOST_FEATURES and self.homology.count() <= latent.MOST_EDGES:
            names = sorted(r["gene"] for r in self.genes.select("gene").distinct().collect())
            if self.packed is None:
                self.packed = cut(latent.packed(self.expr, self.cells, names))
            current = homology.weighted(self.refined if self.refined is not None else self.homology, self.genes)
            shaped = current.withColumn("weight", tanh_scale(F.col("weight")))
            return latent.joint(self.packed, self.expr, self.cells, self.genes, shaped, joint, names, self.species)
        scaled = expression.scaled(self.expr, self.cells, self.genes)
        parts = [scaled]
        if self.homology is not None:
            current = homology.weighted(self.refined if self.refined is not None else self.homology, self.genes)
            shaped = current.withColumn("weight", tanh_scale(F.col("weight")))
            # Sums of the shaped graph's columns would cancel against the deviations below, so they aren't taken.
            parts.append(expression.scaled(expression.translate(scaled, shaped), self.cells, self.genes))
        rows = reduce(DataFrame.unionByName, parts)
        return expression.vectors(expression.centred(expression.project(rows, joint), self.cells))

    def run(
        self,
        iterations: int = constants.ITERATIONS,
        hops: int | dict[str, int] = constants.HOPS,
        k: int = constants.NEIGHBOURS,
        least: float = 0.0,
        mode: str = "pearson",
        scale_edges_by_corr: bool = True,
        cocluster: set[str] | frozenset[str] = frozenset(),
        pairwise: bool = True,
        by_weight: bool = False,
        search: str = "exact",
        near: DataFrame | None = None,
        latent: DataFrame | None = None,
    ) -> "Mapping":
        """Translate, project, find neighbours, stitch; between passes, re-weight homology from its first form.

        ``search`` is exact (all pairs of cells) or approximate (cells near the same centres, ``knn.approximate``).
        With ``near(src, dst, dst_species, weight)`` and ``latent(cell, species, vec)`` the projection of every pass is taken from there."""
        if k < 1 or iterations < 1:
            raise ValueError("k and iterations are 1 or more")
        unknown = set(cocluster) - set(self.species)
        if unknown:
            raise SpeciesNotFoundError(", ".join(sorted(unknown)))
        if search not in ("exact", "approximate"):
            raise ValueError(f"search is exact or approximate, not {search}")
        find = knn.nearest if search == "exact" else knn.approximate
        self.k = k
        if (near is None) != (latent is None):
            raise ValueError("near and latent come together")
        around = self._neighbourhoods(hops, set(cocluster))
        for i in range(iterations):
            self.latent = cut(self._joint()) if latent is None else latent
            self.knn = cut(knn.weights(find(self.latent, k))) if near is None else near
            sent = self._sent(around, set(cocluster))
            similar = stitch.mutual(sent)
            if scale_edges_by_corr:
                similar = stitch.rescaled(similar, self.latent)
            self.edges = cut(stitch.strongest(similar, self.cells, k, pairwise))
            self.graph = cut(stitch.stitched(self.edges, self.cell_graph, self.cells, k, pairwise))
            log.info("pass %d of %d is stitched", i + 1, iterations)
            if i + 1 < iterations and self.homology is not None:
                self.refine(least, mode, by_weight)
        return self

    def _neighbourhoods(self, hops: int | dict[str, int], cocluster: set[str]) -> DataFrame:
        parts = []
        for species in self.species:
            if species in cocluster:
                continue
            own = self.cells.filter(F.col("species") == species)
            inside = self.cell_graph.join(own.select(F.col("cell").alias("src")), "src", "left_semi")
            parts.append(stitch.neighbourhoods(inside, own, hops if isinstance(hops, int) else hops[species]))
        return cut(reduce(DataFrame.unionByName, parts)) if parts else self.spark.createDataFrame([], "src string, dst string")

    def _sent(self, near: DataFrame, cocluster: set[str]) -> DataFrame:
        """With any dataset by clusters, no small sums are left out."""
        sums = stitch.coarsened(self.knn, near, 0.0 if cocluster else 0.1)
        if cocluster:
            sums = sums.unionByName(stitch.coclustered(self.knn, self.cells.filter(F.col("species").isin(list(cocluster)))))
        return cut(sums)

    def refine(self, least: float = 0.0, mode: str = "pearson", by_weight: bool = False) -> DataFrame:
        """Homology with the correlations under the present graph."""
        self._need("graph")
        self.refined = cut(refine.refined(self.homology, self.graph, self.expr, self.cells, self.genes, least, mode, by_weight))
        self.history.append(self.refined)
        return self.refined

    def _need(self, name: str):
        value = getattr(self, name)
        if value is None:
            raise MappingError(f"there is no {name} yet; run the mapping (with a refinement for correlations)")
        return value

    def alignment(self) -> DataFrame:
        return stitch.alignment_means(self._need("edges"), self.cells, self.k)

    def query_gene(self, gene: str) -> dict[str, DataFrame]:
        """Homologues of a feature by sequence and by correlation."""
        name = homology.resolve(self.genes, gene)
        return {"sequence": homology.neighbours(self._need("homology"), name), "correlation": homology.neighbours(self._need("refined"), name)}

    def query_gene_pair(self, a: str, b: str) -> dict[str, DataFrame]:
        a, b = homology.resolve(self.genes, a), homology.resolve(self.genes, b)
        return {"sequence": homology.edge(self._need("homology"), a, b), "correlation": homology.edge(self._need("refined"), a, b)}

    def mapping_scores(self, species: list[str] | None = None, n_top: int = 0) -> DataFrame:
        cells = self.cells if species is None else self.cells.filter(F.col("species").isin(species))
        return scores.mapping_scores(self._need("edges"), self._qualified(cells), n_top, self.k)

    def _qualified(self, cells: DataFrame) -> DataFrame:
        return cells.withColumn("cluster", F.concat("species", F.lit("_"), "cluster"))

    def pair_finder(self) -> GenePairFinder:
        return GenePairFinder(self._need("edges"), self._need("refined"), self.expr, self._qualified(self.cells), self.genes, self.mapping_scores(), self.k)

    def substitutions(self, orthologs: DataFrame, paralogs_: DataFrame | None = None, threshold: float = constants.SUBSTITUTION_THRESHOLD) -> DataFrame:
        """Paralogs that correlate better than the orthologs they could stand for, the largest difference first."""
        rows = paralogs.substitutions(self._need("refined"), orthologs, paralogs_, self.homology, threshold)
        return rows.orderBy(F.desc("corr_diff"), "ortholog_pair", "paralog_pair")

    def cluster_triangles(self, threshold: float = constants.ALIGNMENT_THRESHOLD) -> DataFrame:
        return triangles.cluster_triangles(self.mapping_scores(), self._qualified(self.cells), threshold)

    def gene_triangles(self, orthologs: DataFrame, threshold: float = constants.CORRELATION_THRESHOLD, p_threshold: float = constants.TRIANGLE_P_THRESHOLD) -> DataFrame:
        """Orthologous triangles with the clusters that their features mark, the best least correlation first."""
        rows = triangles.gene_triangles(self._need("refined"), orthologs, threshold, self.pair_finder().markers, p_threshold)
        return rows.orderBy(F.desc("min_corr"), "a", "b", "c")

    def enrichment(self, annotations: DataFrame, delimiter: str = "", align_thr: float = 0.1, thr: float = constants.PAIR_P_THRESHOLD, n_top: int = 0) -> FunctionalEnrichment:
        """Enrichment of the linked features of all mapped clusters."""
        return FunctionalEnrichment(self.pair_finder().find_all(align_thr=align_thr, thr=thr, n_top=n_top), sets_from(checked(annotations, "annotations"), delimiter))

    def save(self, folder: str) -> None:
        tables = {n: getattr(self, n) for n in ("expr", "cells", "genes", "cell_graph", "loadings", "homology", "refined", "knn", "latent", "edges", "graph")}
        tables |= {f"history_{i}": t for i, t in enumerate(self.history)}
        store.save(self.spark, {n: t for n, t in tables.items() if t is not None}, folder, {"k": self.k})

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> "Mapping":
        tables = store.load(spark, folder)
        made = cls.__new__(cls)
        made.spark, made.k = spark, store.load_settings(spark, folder).get("k", constants.NEIGHBOURS)
        made.packed = None
        made.history = [tables[f"history_{i}"] for i in range(sum(n.startswith("history_") for n in tables))]
        for name in ("expr", "cells", "genes", "cell_graph", "loadings", "homology", "refined", "knn", "latent", "edges", "graph"):
            setattr(made, name, tables.get(name))
        made.species = sorted(r["species"] for r in made.cells.select("species").distinct().collect())
        return made
