"""Orthologs, paralogs, and paralogs that took an ortholog's place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossweave.constants import EUKARYOTES, SUBSTITUTION_THRESHOLD
from crossweave.functions.text import encode_pair, groups_at, species_of
from crossweave.operators.pairs import both_ways, canonical, without
from crossweave.sources.checkpoint import cut

#: Members of a group in a block; meetings of two blocks in a task, and tasks at most.
BLOCK = 1024
MEETINGS = 4
MOST_TASKS = 16384


def orthology_groups(packed: DataFrame, taxon: int = EUKARYOTES) -> DataFrame:
    """species, gene, og: the orthology groups of og(species, gene, groups) at a taxon."""
    return packed.filter(F.col("groups").isNotNull()).select("species", "gene", F.explode(groups_at(F.col("groups"), taxon, EUKARYOTES)).alias("og")).distinct()


def orthology_pairs(packed: DataFrame, taxon: int = EUKARYOTES, block: int = BLOCK) -> DataFrame:
    """a < b: features of different datasets in one group. A group's pairs are its result, so they aren't fewer.

    Groups are cut into blocks by hash; two blocks are met in one task, so a group's pairs are spread however few groups there
    are. Features that share several groups are paired in the first of these, so pairs needn't be compared with each other."""
    own = orthology_groups(packed, taxon).filter("species IS NOT NULL AND gene IS NOT NULL").groupBy("species", "gene").agg(F.array_sort(F.collect_set("og")).alias("ogs"))
    rows = cut(own.select("species", "gene", "ogs", F.posexplode("ogs").alias("place", "og")).select("species", "gene", "og", F.slice("ogs", F.lit(1), F.col("place")).alias("before")))
    sizes = rows.groupBy("og").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    meetings = sizes.agg(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2)).first()[0] or 0
    tasks = int(min(MOST_TASKS, meetings // MEETINGS + 1))
    placed = rows.join(sizes, "og").withColumn("at", F.pmod(F.xxhash64("gene"), F.col("blocks")).cast("int"))
    one = placed.select("og", F.col("at").alias("low"), F.explode(F.sequence("at", F.col("blocks") - 1)).alias("high"), F.col("species").alias("s1"), F.col("gene").alias("g1"), F.col("before").alias("b1"))
    two = placed.select("og", F.explode(F.sequence(F.lit(0), F.col("at"))).alias("low"), F.col("at").alias("high"), F.col("species").alias("s2"), F.col("gene").alias("g2"), F.col("before").alias("b2"))
    # By number, as adaptive execution would gather blocks that are small but make many pairs.
    one, two = (side.repartition(tasks, "og", "low", "high") for side in (one, two))
    met = one.join(two.hint("merge"), ["og", "low", "high"]).filter((F.col("s1") != F.col("s2")) & (F.col("g1") != F.col("g2")) & ((F.col("low") < F.col("high")) | (F.col("g1") < F.col("g2"))) & ~F.arrays_overlap("b1", "b2"))
    pairs = met.select(F.least("g1", "g2").alias("a"), F.greatest("g1", "g2").alias("b"))
    # A name in several datasets can make a pair more than once.
    several = rows.groupBy("gene").agg(F.min("species").alias("s1"), F.max("species").alias("s2")).filter("s1 <> s2")
    return pairs.distinct() if several.limit(1).count() else pairs


def propagated(orthologs: DataFrame, paralogs: DataFrame) -> DataFrame:
    """Orthologs and, for paralogs a, a' within a dataset and an ortholog b of a, the pair (a', b)."""
    own = both_ways(paralogs).filter(species_of(F.col("a")) == species_of(F.col("b")))
    step = own.select("a", F.col("b").alias("a2")).join(both_ways(orthologs), "a").select(F.col("a2").alias("a"), "b")
    return canonical(orthologs.select("a", "b").union(step)).filter("a <> b")


def substitutions(homology: DataFrame, orthologs: DataFrame, paralogs: DataFrame | None = None, original: DataFrame | None = None, threshold: float = SUBSTITUTION_THRESHOLD, propagate: bool = True) -> DataFrame:
    """Pairs whose paralogous pair correlates better, by more than the threshold.

    ``homology`` has the correlations; features it doesn't have are left out. Without ``paralogs`` every edge of
    ``original`` (or ``homology``) is one, unless it is an ortholog. Every dataset of the ortholog pair has to occur in
    the paralog pair."""
    known = homology.select(F.col("g1").alias("gene")).distinct()
    inside = lambda p: p.join(known, p["a"] == known["gene"], "left_semi").join(known, p["b"] == known["gene"], "left_semi")
    full = propagated(orthologs, paralogs) if paralogs is not None and propagate else canonical(orthologs)
    orth = inside(full)
    every = paralogs.select("a", "b") if paralogs is not None else (homology if original is None else original).select(F.col("g1").alias("a"), F.col("g2").alias("b"))
    para = both_ways(without(inside(every), orth))
    met = both_ways(orth).select(F.col("a").alias("x"), F.col("b").alias("o")).join(para.select(F.col("a").alias("x"), F.col("b").alias("p")), "x")
    corr = homology.select("g1", "g2", "weight")
    for end, name in (("o", "ortholog_corr"), ("p", "paralog_corr")):
        met = met.join(corr.select(F.col("g1").alias("x"), F.col("g2").alias(end), F.col("weight").alias(name)), ["x", end], "left").na.fill(0.0, [name])
    rated = met.withColumn("corr_diff", F.col("paralog_corr") - F.col("ortholog_corr")).filter(F.col("corr_diff") > threshold)
    species = lambda *g: F.array(*[species_of(F.col(c)) for c in g])
    kept = rated.filter(F.size(F.array_except(species("x", "o"), species("x", "p"))) == 0)
    return kept.select(encode_pair(F.col("x"), F.col("o")).alias("ortholog_pair"), encode_pair(F.col("x"), F.col("p")).alias("paralog_pair"), "ortholog_corr", "paralog_corr", "corr_diff")
