"""Expression frames expr(species, cell, gene, value) of non-zeros: statistics count the cells that have no row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossweave.functions.numeric import guarded


def cell_counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy("species").agg(F.count(F.lit(1)).alias("n"))


def gene_stats(expr: DataFrame, cells: DataFrame) -> DataFrame:
    """species, gene, mean, sd: over all cells; population standard deviation, 1 where it is 0."""
    sums = expr.groupBy("species", "gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    # One row for each dataset: small whatever the number of cells.
    joined = sums.join(F.broadcast(cell_counts(cells)), "species")
    mean = F.col("s") / F.col("n")
    variance = F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))
    return joined.select("species", "gene", mean.alias("mean"), guarded(F.sqrt(variance)).alias("sd"))


def factors(expr: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """species, gene, __f: a feature's weight over its deviation among the dataset's cells."""
    return gene_stats(expr, cells).join(genes.select("gene", "weight"), "gene").select("species", "gene", (F.col("weight") / F.col("sd")).alias("__f"))


def scaled(expr: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """Values over the feature's deviation among the dataset's cells, not centred, times the feature's weight (whatever dataset it is of)."""
    return expr.join(factors(expr, cells, genes), ["species", "gene"]).select("species", "cell", "gene", (F.col("value") * F.col("__f")).alias("value")).filter("value <> 0")


def standardised(expr: DataFrame, stats: DataFrame) -> DataFrame:
    """Non-zeros minus the mean, over the deviation; what isn't positive is left out."""
    return expr.join(stats, ["species", "gene"]).select("species", "cell", "gene", ((F.col("value") - F.col("mean")) / F.col("sd")).alias("value")).filter("value > 0")


def standardised_rows(expr: DataFrame, genes: DataFrame) -> DataFrame:
    """As ``standardised``, by each cell's own mean and deviation over all features of its dataset."""
    n = genes.groupBy("species").agg(F.countDistinct("gene").alias("n"))
    sums = expr.groupBy("species", "cell").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).join(F.broadcast(n), "species")
    mean = F.col("s") / F.col("n")
    stats = sums.select("species", "cell", mean.alias("mean"), guarded(F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))).alias("sd"))
    return expr.join(stats, ["species", "cell"]).select("species", "cell", "gene", ((F.col("value") - F.col("mean")) / F.col("sd")).alias("value")).filter("value > 0")


def preprocess(counts: DataFrame, cells: DataFrame, least: float = 1.0, low: float = 0.0, high: float = 0.96, base: float = 2.0) -> DataFrame:
    """Counts scaled to the dataset's median total, log(1 + x), and features found (>= ``least``) in a share of cells within [low, high]."""
    totals = counts.groupBy("species", "cell").agg(F.sum("value").alias("total"))
    median = totals.groupBy("species").agg(F.percentile("total", 0.5).alias("median"))
    shaped = counts.join(totals, ["species", "cell"]).join(F.broadcast(median), "species").select("species", "cell", "gene", (F.log1p(F.col("value") * F.col("median") / F.col("total")) / F.log(F.lit(base))).alias("value"))
    found = shaped.filter(F.col("value") >= least).groupBy("species", "gene").agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(cell_counts(cells)), "species")
    kept = found.filter((F.col("k") / F.col("n") >= low) & (F.col("k") / F.col("n") <= high)).select("species", "gene")
    return shaped.join(kept, ["species", "gene"], "left_semi")


def translate(expr: DataFrame, homology: DataFrame) -> DataFrame:
    """species, cell, gene, value: each dataset's values carried to the features of the others along homology."""
    edges = homology.filter("s1 <> s2").select(F.col("g1").alias("gene"), F.col("g2").alias("to"), F.col("weight").alias("w"))
    return expr.join(edges, "gene").groupBy("species", "cell", "to").agg(F.sum(F.col("value") * F.col("w")).alias("value")).withColumnRenamed("to", "gene")


def project(expr: DataFrame, loadings: DataFrame) -> DataFrame:
    """species, cell, pc, value: Σ_gene value · loading, for loadings(gene, pc, value)."""
    right = loadings.select("gene", "pc", F.col("value").alias("l"))
    return expr.join(right, "gene").groupBy("species", "cell", "pc").agg(F.sum(F.col("value") * F.col("l")).alias("value"))


def centred(latent: DataFrame, cells: DataFrame) -> DataFrame:
    """Projected values of every cell minus their mean over the dataset's cells; cells without a row count as 0."""
    means = latent.groupBy("species", "pc").agg(F.sum("value").alias("s")).join(F.broadcast(cell_counts(cells)), "species").select("species", "pc", (F.col("s") / F.col("n")).alias("mean"))
    every = cells.select("species", "cell").join(means, "species")
    return every.join(latent, ["species", "cell", "pc"], "left").select("species", "cell", "pc", (F.coalesce("value", F.lit(0.0)) - F.col("mean")).alias("value"))


def vectors(latent: DataFrame) -> DataFrame:
    """cell, species, vec: the components of each cell as one array, in order of pc; missing ones are 0."""
    order = [r["pc"] for r in latent.select("pc").distinct().orderBy("pc").collect()]  # some hundred
    values = F.map_from_entries(F.collect_list(F.struct("pc", "value")))
    wide = latent.groupBy("species", "cell").agg(values.alias("__m"))
    return wide.select("cell", "species", F.array(*[F.coalesce(F.col("__m")[F.lit(p)], F.lit(0.0)) for p in order]).alias("vec"))


def components(expr: DataFrame, cells: DataFrame, genes: DataFrame, n: int) -> DataFrame:
    """gene, pc, value: principal axes of each dataset's scaled features (at most some thousand of them)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    made = None
    for species in sorted(r["species"] for r in cells.select("species").distinct().collect()):
        own = cells.filter(F.col("species") == species)
        names = [r["gene"] for r in genes.filter((F.col("species") == species) & (F.col("weight") > 0)).select("gene").distinct().orderBy("gene").collect()]
        values = scaled(expr.filter(F.col("species") == species), own, genes).groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("gene", "value"))).alias("m"))
        rows = own.select("cell").join(values, "cell", "left").select(array_to_vector(F.array(*[F.coalesce(F.col("m")[F.lit(g)], F.lit(0.0)) for g in names])).alias("x"))
        axes = PCA(k=min(n, len(names)), inputCol="x", outputCol="y").fit(rows).pc.toArray()
        one = expr.sparkSession.createDataFrame([(g, pc, float(v)) for g, row in zip(names, axes) for pc, v in enumerate(row)], "gene string, pc int, value double").withColumn("species", F.lit(species))
        made = one if made is None else made.unionByName(one)
    return made
