"""The driver's tables read as the engine's: which table stands for what, in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, d: str) -> DataFrame:
    """cells: customers, by market segment, in clusters by nation."""
    species = F.lower(F.substring("c_mktsegment", 1, 2))
    return table(spark, d, "customer").select(species.alias("species"), F.col("c_custkey").alias("cell"), F.concat(species, F.lit("_"), F.col("c_nationkey").cast("string")).alias("cluster"))


CELLS = "SELECT lower(substr(c_mktsegment,1,2)) AS species, c_custkey AS cell, lower(substr(c_mktsegment,1,2)) || '_' || c_nationkey AS cluster FROM customer"


def expr(spark: SparkSession, d: str) -> DataFrame:
    """expr: quantities of part groups bought by customers."""
    lines = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 100).alias("g"), "l_quantity")
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("cell"))
    # Dealt out by customer once: the sums, the segment and what gathers a customer's groups need no further shuffle.
    bought = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select("cell", "g", "l_quantity").repartition("cell")
    sums = bought.groupBy("cell", "g").agg(F.sum("l_quantity").alias("value"))
    # The segment goes on after the sum: one row for each customer and group.
    return sums.join(customers(spark, d).select("species", "cell"), "cell").select("species", "cell", F.concat("species", F.lit("_"), F.col("g").cast("string")).alias("gene"), "value")


EXPR = """SELECT c.species, c.cell, c.species || '_' || (l_partkey % 100) AS gene, sum(l_quantity) AS value
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN cells c ON c.cell = o_custkey GROUP BY ALL"""


def genes(spark: SparkSession, d: str) -> DataFrame:
    """genes: 100 part groups for each segment, with weights by rule."""
    species = customers(spark, d).select("species").distinct()
    number = F.explode(F.sequence(F.lit(0), F.lit(99)))
    return species.select("species", number.alias("g")).select("species", F.concat("species", F.lit("_"), F.col("g").cast("string")).alias("gene"), ((F.col("g") * 37 % 100) / 100).alias("weight"))


GENES = "SELECT species, species || '_' || g AS gene, (g * 37 % 100) / 100 AS weight FROM (SELECT DISTINCT species FROM cells), range(100) t(g)"


def shared_homology(spark: SparkSession, d: str) -> DataFrame:
    """homology: part groups of different segments whose numbers are near."""
    g = genes(spark, d).select("species", "gene", F.split_part("gene", F.lit("_"), F.lit(2)).cast("int").alias("g"))
    near = g.select(F.col("gene").alias("g1"), F.col("species").alias("s1"), "g", F.explode(F.array(*map(F.lit, (0, 3, 7)))).alias("step"))
    other = g.select(F.col("gene").alias("g2"), F.col("species").alias("s2"), F.col("g").alias("h"))
    one = near.join(other, (F.col("h") == (F.col("g") + F.col("step")) % 100) & (F.col("s1") < F.col("s2"))).select("g1", "g2", "s1", "s2", (1.0 / (F.col("step") + 1)).alias("weight"))
    return one.unionByName(one.select(F.col("g2").alias("g1"), F.col("g1").alias("g2"), F.col("s2").alias("s1"), F.col("s1").alias("s2"), "weight"))


HOMOLOGY = """SELECT g1, g2, s1, s2, weight FROM (
 SELECT a.gene AS g1, b.gene AS g2, a.species AS s1, b.species AS s2, 1.0::DOUBLE / (step + 1) AS weight
 FROM genes a, (VALUES (0), (3), (7)) t(step), genes b WHERE a.species < b.species AND split_part(b.gene,'_',2)::INT = (split_part(a.gene,'_',2)::INT + step) % 100) e
 UNION ALL SELECT b.gene, a.gene, b.species, a.species, 1.0::DOUBLE / (step + 1)
 FROM genes a, (VALUES (0), (3), (7)) t(step), genes b WHERE a.species < b.species AND split_part(b.gene,'_',2)::INT = (split_part(a.gene,'_',2)::INT + step) % 100"""


def loadings(spark: SparkSession, d: str) -> DataFrame:
    g = genes(spark, d).select("gene", F.split_part("gene", F.lit("_"), F.lit(2)).cast("int").alias("g"))
    pc = F.explode(F.sequence(F.lit(0), F.lit(3)))
    return g.select("gene", "g", pc.alias("pc")).select("gene", "pc", (((F.col("g") * (F.col("pc") + 3)) % 11 - 5) / 8).alias("value"))


LOADINGS = "SELECT gene, pc::INT AS pc, ((split_part(gene,'_',2)::INT * (pc + 3)) % 11 - 5) / 8 AS value FROM genes, range(4) t(pc)"


def hits(spark: SparkSession, d: str) -> DataFrame:
    """hits of parts and suppliers, in two directions."""
    part = F.concat(F.lit("pa_"), F.col("l_partkey").cast("string"))
    supplier = F.concat(F.lit("su_"), F.col("l_suppkey").cast("string"))
    forward = F.col("l_linenumber") % 2 == 0
    return table(spark, d, "lineitem").select(
        F.when(forward, part).otherwise(supplier).alias("query"), F.when(forward, supplier).otherwise(part).alias("target"), F.col("l_discount").alias("evalue"), F.col("l_extendedprice").alias("bitscore"), (F.col("l_linenumber") % 2).alias("direction")
    )


HITS = """SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'pa_' || l_partkey ELSE 'su_' || l_suppkey END AS query,
 CASE WHEN l_linenumber % 2 = 0 THEN 'su_' || l_suppkey ELSE 'pa_' || l_partkey END AS target,
 l_discount AS evalue, l_extendedprice AS bitscore, l_linenumber % 2 AS direction FROM lineitem"""


def latent(spark: SparkSession, d: str, datasets: int = 2) -> DataFrame:
    """latent: embeddings, dealt to datasets by id, in clusters by label."""
    species = F.concat(F.lit("s"), (F.col("vec_id") % datasets).cast("string"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("cell"), species.alias("species"), F.concat(species, F.lit("_"), F.col("label").cast("string")).alias("cluster"), F.col("embedding").cast("array<double>").alias("vec"))


def latent_sql(datasets: int = 2) -> str:
    return f"SELECT vec_id AS cell, 's' || (vec_id % {datasets}) AS species, 's' || (vec_id % {datasets}) || '_' || label AS cluster, embedding::DOUBLE[] AS vec FROM embeddings"


#: Common tables of the oracles, each after those it needs.
BASE = {"cells": CELLS, "expr": EXPR, "genes": GENES, "homology": HOMOLOGY, "loadings": LOADINGS, "hits": HITS, "latent": latent_sql()}
NEEDS = {"expr": ["cells"], "genes": ["cells"], "homology": ["genes"], "loadings": ["genes"]}


def with_tables(names: str, body: str, **more: str) -> str:
    """A query with common tables by name, and further ones."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    parts = [f"{n} AS MATERIALIZED ({BASE[n]})" for n in order] + [f"{n} AS MATERIALIZED ({sql})" for n, sql in more.items()]
    return f"WITH {', '.join(parts)} {body}"
