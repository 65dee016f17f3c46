"""Triangles of mapped clusters and of homologous features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossweave.constants import ALIGNMENT_THRESHOLD, CORRELATION_THRESHOLD, TRIANGLE_P_THRESHOLD


def triangles(edges: DataFrame) -> DataFrame:
    """a < b < c with w_ab, w_ac, w_bc, for edges(a, b, w) with a < b.

    Edges point from the end with fewer edges to the other, so that the pairs of edges that leave an end are few
    whatever hubs there are (at most a root of the number of edges each); each triangle is found at its least end."""
    degree = edges.select(F.explode(F.array("a", "b")).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("d"))
    one, two = (degree.select(F.col("x").alias(x), F.struct("d", "x").alias(f"__{x}")) for x in "ab")
    rated = edges.join(one, "a").join(two, "b")
    least, most = F.least("__a", "__b"), F.greatest("__a", "__b")
    out = rated.select(least["x"].alias("u"), most.alias("v"), "w")
    x, y = (out.select("u", F.col("v").alias(v), F.col("w").alias(f"w_{v}")) for v in "xy")
    closing = out.select(F.col("u").alias("x_name"), F.col("v.x").alias("y_name"), F.col("w").alias("w_xy"))
    met = x.join(y, "u").filter("x < y").select("u", F.col("x.x").alias("x_name"), F.col("y.x").alias("y_name"), "w_x", "w_y").join(closing, ["x_name", "y_name"])
    side = lambda p, q, w: F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q"), F.col(w).alias("w"))
    # In order, the sides are ab, ac and bc.
    sides = met.select(F.array_sort(F.array(side("u", "x_name", "w_x"), side("u", "y_name", "w_y"), side("x_name", "y_name", "w_xy"))).alias("s"))
    return sides.select(F.col("s")[0]["p"].alias("a"), F.col("s")[0]["q"].alias("b"), F.col("s")[1]["q"].alias("c"), *[F.col("s")[i]["w"].alias(n) for i, n in enumerate(("w_ab", "w_ac", "w_bc"))])


def cluster_triangles(scores: DataFrame, cells: DataFrame, threshold: float = ALIGNMENT_THRESHOLD) -> DataFrame:
    """Three clusters of three datasets with every score over the threshold (strictly); scores are kept."""
    species = cells.select("cluster", "species").distinct()
    one, two = (species.select(F.col("cluster").alias(c), F.col("species").alias(s)) for c, s in (("c1", "s1"), ("c2", "s2")))
    strong = scores.filter((F.col("score") > threshold) & (F.col("c1") < F.col("c2"))).join(one, "c1").join(two, "c2").filter("s1 <> s2")
    found = triangles(strong.select(F.col("c1").alias("a"), F.col("c2").alias("b"), F.col("score").alias("w")))
    where = {x: species.select(F.col("cluster").alias(x), F.col("species").alias(f"s_{x}")) for x in "ac"}
    return found.join(where["a"], "a").join(where["c"], "c").filter("s_a <> s_c").drop("s_a", "s_c")


def gene_triangles(homology: DataFrame, orthologs: DataFrame, threshold: float = CORRELATION_THRESHOLD, markers: DataFrame | None = None, p_threshold: float = TRIANGLE_P_THRESHOLD) -> DataFrame:
    """Three features of three datasets, all edges at least at the threshold and their least over it, all three pairs orthologs.

    With ``markers(gene, cluster, score, pval)``, ``type_*`` names each feature's best cluster and those where it is significant."""
    known = orthologs.select(F.least("a", "b").alias("g1"), F.greatest("a", "b").alias("g2")).distinct()
    # Only orthologous edges over the threshold can be part of a result, so the others make no triangles.
    edges = homology.filter((F.col("weight") > threshold) & (F.col("g1") < F.col("g2")) & (F.col("s1") != F.col("s2"))).join(known, ["g1", "g2"], "left_semi")
    found = triangles(edges.select(F.col("g1").alias("a"), F.col("g2").alias("b"), F.col("weight").alias("w")))
    species = edges.select(F.explode(F.array(F.struct(F.col("g1").alias("g"), F.col("s1").alias("s")), F.struct(F.col("g2").alias("g"), F.col("s2").alias("s")))).alias("e")).select("e.g", "e.s").distinct()
    for x in "abc":
        found = found.join(species.select(F.col("g").alias(x), F.col("s").alias(f"s_{x}")), x)
    flags = {f"type_{pair}": F.lit("ortholog") for pair in ("ab", "ac", "bc")}
    rated = found.withColumns(flags | {"n_orthologs": F.lit(3), "min_corr": F.least("w_ab", "w_ac", "w_bc")})
    kept = rated.filter(F.col("s_a") != F.col("s_c"))
    if markers is not None:
        types = cell_types(markers, p_threshold)
        for x in "abc":
            kept = kept.join(types.select(F.col("gene").alias(x), F.col("types").alias(f"types_{x}")), x, "left")
    first = ["a", "b", "c", "s_a", "s_b", "s_c", "w_ab", "w_ac", "w_bc", "type_ab", "type_ac", "type_bc", "n_orthologs", "min_corr"]
    return kept.select(*first, *[c for c in kept.columns if c not in first])


def cell_types(markers: DataFrame, p_threshold: float = TRIANGLE_P_THRESHOLD) -> DataFrame:
    """gene, types: the cluster with the best score and all with a p-value within the threshold, joined by semicolons."""
    best = F.max_by("cluster", F.struct("score", "cluster"))
    rows = markers.groupBy("gene").agg(best.alias("best"), F.collect_set(F.when(F.col("pval") <= p_threshold, F.col("cluster"))).alias("some"))
    return rows.select("gene", F.array_join(F.array_sort(F.array_union(F.array("best"), "some")), ";").alias("types"))
