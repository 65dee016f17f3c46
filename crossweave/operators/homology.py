"""The feature-homology graph: from hits to a pruned, symmetric, weighted graph homology(g1, g2, s1, s2, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossweave.constants import EVALUE_THRESHOLD, PRUNE_THRESHOLD
from crossweave.exceptions import GeneNotFoundError
from crossweave.functions.numeric import guarded
from crossweave.functions.text import qualify, species_of

#: What a reader of delimited files may take for a missing name.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def usable_hits(hits: DataFrame, evalue: float = EVALUE_THRESHOLD, drop_missing_tokens: bool = False) -> DataFrame:
    """query, target, bitscore of hits with names and an e-value within the threshold (inclusive).

    Names that only look like missing values (``NA``, ``null``) stay, unless asked otherwise."""
    named = hits.filter(F.col("query").isNotNull() & F.col("target").isNotNull())
    if drop_missing_tokens:
        named = named.filter(~F.col("query").isin(MISSING) & ~F.col("target").isin(MISSING))
    return named.filter(F.col("evalue") <= evalue).select("query", "target", "bitscore")


def qualified_hits(hits: DataFrame, query_species: Column, target_species: Column) -> DataFrame:
    return hits.withColumns({"query": qualify(F.col("query"), query_species), "target": qualify(F.col("target"), target_species)})


def best_hits(hits: DataFrame) -> DataFrame:
    """One row for each (query, target): the best score, whatever the order of the file."""
    return hits.groupBy("query", "target").agg(F.max("bitscore").alias("bitscore"))


def graph(forward: DataFrame, backward: DataFrame, reciprocal: bool = True) -> DataFrame:
    """Symmetric graph from the hits of both directions; an edge is the mean of its two scores.

    Reciprocal: pairs found in one direction only are left out; else their missing score is 0."""
    a = best_hits(forward).select(F.col("query").alias("g1"), F.col("target").alias("g2"), F.col("bitscore").alias("x"))
    b = best_hits(backward).select(F.col("target").alias("g1"), F.col("query").alias("g2"), F.col("bitscore").alias("y"))
    if reciprocal:
        one = a.join(b, ["g1", "g2"]).select("g1", "g2", ((F.col("x") + F.col("y")) / 2).alias("weight"))
    else:
        both = a.withColumnRenamed("x", "s").unionByName(b.withColumnRenamed("y", "s"))
        one = both.groupBy("g1", "g2").agg((F.sum("s") / 2).alias("weight"))
    return symmetric(one)


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of edges (g1, g2, weight), with dataset ids."""
    # Turned around row by row: a union would compute the edges twice.
    there, back = F.struct("g1", "g2"), F.struct(F.col("g2").alias("g1"), F.col("g1").alias("g2"))
    two = edges.select(F.explode(F.array(there, back)).alias("e"), "weight").select("e.g1", "e.g2", "weight")
    return two.select("g1", "g2", species_of(F.col("g1")).alias("s1"), species_of(F.col("g2")).alias("s2"), "weight")


def coarsen(homology: DataFrame, names: DataFrame) -> DataFrame:
    """Edges between symbols: ``names(header, symbol, ord)`` renames ends (the first name wins, unknown ends keep theirs); the best edge stays."""
    first = names.groupBy("header").agg(F.min_by("symbol", "ord").alias("symbol"))
    one, two = (first.select(F.col("header").alias(g), F.col("symbol").alias(f"__{g}")) for g in ("g1", "g2"))
    renamed = homology.join(one, "g1", "left").join(two, "g2", "left").select(F.coalesce("__g1", "g1").alias("g1"), F.coalesce("__g2", "g2").alias("g2"), "s1", "s2", "weight")
    return renamed.groupBy("g1", "g2", "s1", "s2").agg(F.max("weight").alias("weight"))


def prune(homology: DataFrame, share: float = PRUNE_THRESHOLD, per_species: bool = False) -> DataFrame:
    """Edges that reach a share of the best edge of either end (over all datasets, or each)."""
    keys = lambda g, s: [g, s] if per_species else [g]
    first, second = Window.partitionBy(*keys("g1", "s2")), Window.partitionBy(*keys("g2", "s1"))
    rated = homology.withColumns({"__m1": F.max("weight").over(first), "__m2": F.max("weight").over(second)})
    return rated.filter((F.col("weight") >= share * F.col("__m1")) | (F.col("weight") >= share * F.col("__m2"))).drop("__m1", "__m2")


def weighted(homology: DataFrame, genes: DataFrame) -> DataFrame:
    """Each row over its largest weight, and only features with a positive weight at both ends (no longer symmetric)."""
    rated = homology.withColumn("weight", F.col("weight") / guarded(F.max("weight").over(Window.partitionBy("g1"))))
    useful = genes.filter("weight > 0").select("gene")
    return rated.join(useful, rated["g1"] == useful["gene"], "left_semi").join(useful, rated["g2"] == useful["gene"], "left_semi").filter("weight <> 0")


def present(homology: DataFrame, genes: DataFrame) -> DataFrame:
    """Edges between features that the datasets have."""
    known = genes.select("gene").distinct()
    return homology.join(known, homology["g1"] == known["gene"], "left_semi").join(known, homology["g2"] == known["gene"], "left_semi")


def resolve(genes: DataFrame, name: str) -> str:
    """A feature's qualified name: the name itself or, for the first dataset that has it, with its id."""
    known = genes.filter((F.col("gene") == name) | (F.concat("species", F.lit("_"), F.lit(name)) == F.col("gene"))).select("gene").distinct()
    found = sorted(r["gene"] for r in known.limit(100).collect())
    if not found:
        raise GeneNotFoundError(f"{name} is in no dataset")
    return name if name in found else found[0]


def neighbours(homology: DataFrame, gene: str) -> DataFrame:
    """gene, weight: the homologues of a feature."""
    return homology.filter(F.col("g1") == gene).select(F.col("g2").alias("gene"), "weight")


def edge(homology: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the weight between two features, 0 without an edge."""
    return homology.filter((F.col("g1") == a) & (F.col("g2") == b)).agg(F.coalesce(F.max("weight"), F.lit(0.0)).alias("weight"))
