"""Queries on neighbours, stitching, refinement and mapping scores."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.operators import knn, linalg, refine, scores, stitch
from crossweave.plans import domain
from crossweave.plans.catalogue import query
from crossweave.plans.domain import latent_sql, table, with_tables
from crossweave.plans.queries_base import SCALED, STATS
from crossweave.plans.session import Mapping

K = 10
#: Neighbours inside a dataset, for the graphs that stitching starts from.
OWN = 5


def r(column, digits: int = 6):
    return F.round(column, digits)


NEAR = f"""SELECT src, dst, dst_species, cos FROM (SELECT a.cell AS src, b.cell AS dst, b.species AS dst_species, list_cosine_similarity(a.vec, b.vec) AS cos FROM latent a JOIN latent b ON a.species <> b.species)
 QUALIFY row_number() OVER (PARTITION BY src, dst_species ORDER BY round(cos, 12) DESC, dst) <= {K}"""
WEIGHTS = """SELECT src, dst, dst_species, s / sum(s) OVER (PARTITION BY src, dst_species) AS weight FROM (
 SELECT src, dst, dst_species, 0.7 + 0.3 * tanh(10 * (greatest(cos, 1e-3) / max(greatest(cos, 1e-3)) OVER (PARTITION BY src, dst_species) - 0.7)) AS s FROM near)"""
INNER = f"""SELECT src, dst, round(cos, 6) AS weight FROM (SELECT a.cell AS src, b.cell AS dst, list_cosine_similarity(a.vec, b.vec) AS cos FROM latent a JOIN latent b ON a.species = b.species AND a.cell <> b.cell)
 QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(cos, 12) DESC, dst) <= {OWN}"""


def near(spark: SparkSession, d: str, datasets: int = 2) -> DataFrame:
    return knn.nearest(domain.latent(spark, d, datasets), K)


def weights(spark: SparkSession, d: str, datasets: int = 2) -> DataFrame:
    return knn.weights(near(spark, d, datasets))


def inner(spark: SparkSession, d: str, datasets: int = 2) -> DataFrame:
    return knn.nearest(domain.latent(spark, d, datasets), OWN, other_species=False).select("src", "dst", r("cos").alias("weight"))


@query(with_tables("latent", "SELECT src, dst, dst_species, round(cos, 6) AS cos FROM near", near=NEAR))
def cosine_knn(spark: SparkSession, d: str) -> DataFrame:
    return near(spark, d).withColumn("cos", r("cos"))


@query(with_tables("latent", "SELECT species, count(*) AS cells, true AS found FROM latent GROUP BY species"))
def cosine_knn_approximate(spark: SparkSession, d: str) -> DataFrame:
    """Whether the approximate search, at its defaults, finds nine of ten of the exact neighbours of each dataset's cells."""
    exact, some = near(spark, d), knn.approximate(domain.latent(spark, d), K)
    hit = exact.join(some.select("src", "dst", F.lit(1).alias("hit")), ["src", "dst"], "left")
    cells = domain.latent(spark, d).select(F.col("cell").alias("src"), "species")
    recall = hit.join(cells, "src").groupBy("species").agg((F.sum("hit") / F.count(F.lit(1)) >= 0.9).alias("found"))
    return cells.groupBy("species").agg(F.count(F.lit(1)).alias("cells")).join(recall, "species").select("species", "cells", "found")


@query(with_tables("latent", "SELECT src, dst, dst_species, round(weight, 6) AS weight FROM knn", near=NEAR, knn=WEIGHTS))
def knn_weights(spark: SparkSession, d: str) -> DataFrame:
    return weights(spark, d).withColumn("weight", r("weight"))


DISTANCE = """SELECT src, dst, dst_species, s / sum(s) OVER (PARTITION BY src, dst_species) AS weight FROM (
 SELECT src, dst, dst_species, 0.7 + 0.3 * tanh(10 * (greatest(e, 1e-3) / max(greatest(e, 1e-3)) OVER (PARTITION BY src, dst_species) - 0.7)) AS s FROM (
 SELECT *, exp(-(1 - cos) / nth_value(1 - cos, 5) OVER (PARTITION BY src, dst_species ORDER BY 1 - cos, dst ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS e FROM near))"""


@query(with_tables("latent", "SELECT src, dst, dst_species, round(weight, 6) AS weight FROM w", near=NEAR, w=DISTANCE))
def knn_distance_weights(spark: SparkSession, d: str) -> DataFrame:
    rows = near(spark, d).select("src", "dst", "dst_species", (1 - F.col("cos")).alias("distance"))
    return knn.distance_weights(rows).withColumn("weight", r("weight"))


@query(with_tables("latent", "SELECT src, dst, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS k FROM knn) WHERE k <= 4", near=NEAR, knn=WEIGHTS))
def topk_per_row(spark: SparkSession, d: str) -> DataFrame:
    return linalg.top_k(weights(spark, d).select("src", "dst", "weight"), 4, ["src"], "weight", ["dst"]).withColumn("weight", r("weight"))


@query(with_tables("", "SELECT src, dst, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY src, dst_species ORDER BY weight DESC, dst) AS k FROM knn) WHERE k <= 3", latent=latent_sql(3), near=NEAR, knn=WEIGHTS))
def topk_per_species(spark: SparkSession, d: str) -> DataFrame:
    """Of more than two datasets, the strongest edges to each."""
    return stitch.strongest(weights(spark, d, 3).select("src", "dst", "weight"), domain.latent(spark, d, 3), 3).withColumn("weight", r("weight"))


@query(with_tables("latent", "SELECT src, dst, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS k FROM knn) WHERE k <= src % 5", near=NEAR, knn=WEIGHTS))
def topk_variable(spark: SparkSession, d: str) -> DataFrame:
    """A cell keeps its id mod 5; 0 keeps nothing."""
    budget = domain.latent(spark, d).select(F.col("cell").alias("src"), (F.col("cell") % 5).alias("k"))
    return linalg.top_k_each(weights(spark, d).select("src", "dst", "weight"), budget, ["src"], "weight", ["dst"]).withColumn("weight", r("weight"))


RINGS = {
    "g": INNER,
    "w1": "SELECT a.src, b.dst, sum(a.weight * b.weight) AS weight FROM g a JOIN g b ON a.dst = b.src GROUP BY ALL",
    "w2": "SELECT a.src, b.dst, sum(a.weight * b.weight) AS weight FROM w1 a JOIN g b ON a.dst = b.src GROUP BY ALL",
    "r1": "SELECT * FROM w1 WHERE (src, dst) NOT IN (SELECT (src, dst) FROM g)",
    "rings": "SELECT src, dst, 0 AS ring, weight FROM g UNION ALL SELECT src, dst, 1, weight FROM r1 UNION ALL SELECT src, dst, 2, weight FROM w2 WHERE (src, dst) NOT IN (SELECT (src, dst) FROM g) AND (src, dst) NOT IN (SELECT (src, dst) FROM r1)",
}
CAPPED = {**RINGS, "hood": "SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ring, round(weight, 12) DESC, dst) AS n FROM rings) JOIN (SELECT cell AS src, count(*) OVER (PARTITION BY species, cluster) AS k FROM latent) USING (src) WHERE n <= k"}
HOPS = 2


@query(with_tables("latent", "SELECT src, dst, ring::INT AS ring, round(weight, 6) AS weight FROM rings", **RINGS))
def khop_rings(spark: SparkSession, d: str) -> DataFrame:
    return stitch.rings(inner(spark, d), HOPS).select("src", "dst", "ring", r("weight").alias("weight"))


def hood(spark: SparkSession, d: str) -> DataFrame:
    return stitch.neighbourhoods(inner(spark, d), domain.latent(spark, d), HOPS)


@query(with_tables("latent", "SELECT src, dst FROM hood", **CAPPED))
def neighborhood_capped(spark: SparkSession, d: str) -> DataFrame:
    return hood(spark, d)


SENT = {**CAPPED, "near": NEAR, "knn": WEIGHTS, "sent": "SELECT k.src, h.src AS dst, sum(weight) AS weight FROM knn k JOIN hood h ON k.dst = h.dst GROUP BY ALL HAVING sum(weight) >= 0.1 - 1e-9"}
MUTUAL = {**SENT, "mut": "SELECT a.src, a.dst, sqrt(a.weight * b.weight) AS weight FROM sent a JOIN sent b ON a.src = b.dst AND a.dst = b.src"}
RESCALED = {
    **MUTUAL,
    "cor": """SELECT m.*, (list_dot_product(a.vec, b.vec) / len(a.vec) - list_avg(a.vec) * list_avg(b.vec)) / sqrt((list_dot_product(a.vec, a.vec) / len(a.vec) - list_avg(a.vec) ** 2) * (list_dot_product(b.vec, b.vec) / len(b.vec) - list_avg(b.vec) ** 2)) AS corr
 FROM mut m JOIN latent a ON m.src = a.cell JOIN latent b ON m.dst = b.cell""",
    "f": "SELECT *, sqrt((0.7 + 0.3 * tanh(10 * (greatest(corr, 1e-3) / max(greatest(corr, 1e-3)) OVER (PARTITION BY src) - 0.7))) * weight) AS e FROM cor",
    "resc": "SELECT src, dst, e * max(weight) OVER (PARTITION BY src) / max(e) OVER (PARTITION BY src) AS weight FROM f",
}
STITCHED = {
    **RESCALED,
    "dk": f"SELECT src, dst, weight FROM resc QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(weight, 12) DESC, dst) <= {K}",
    "nnm": f"SELECT src, dst, sum(weight) AS weight FROM (SELECT src, dst, weight FROM dk UNION ALL SELECT g.src, g.dst, 1 - coalesce(u, 0) / {K} FROM g LEFT JOIN (SELECT src, sum(weight) AS u FROM dk GROUP BY src) x ON g.src = x.src) GROUP BY ALL",
}


def sent(spark: SparkSession, d: str) -> DataFrame:
    return stitch.coarsened(weights(spark, d), hood(spark, d))


def rescaled(spark: SparkSession, d: str) -> DataFrame:
    return stitch.rescaled(stitch.mutual(sent(spark, d)), domain.latent(spark, d))


def strongest(spark: SparkSession, d: str) -> DataFrame:
    return stitch.strongest(rescaled(spark, d), domain.latent(spark, d), K)


@query(with_tables("latent", "SELECT src, dst, round(weight, 6) AS weight FROM sent", **SENT))
def indegree_coarsen(spark: SparkSession, d: str) -> DataFrame:
    return sent(spark, d).withColumn("weight", r("weight"))


@query(with_tables("latent", "SELECT src, b.cell AS dst, round(w, 6) AS weight FROM (SELECT src, cluster, sum(weight) AS w FROM knn JOIN latent ON dst = cell GROUP BY ALL) a JOIN latent b USING (cluster)", near=NEAR, knn=WEIGHTS))
def cocluster_coarsen(spark: SparkSession, d: str) -> DataFrame:
    return stitch.coclustered(weights(spark, d), domain.latent(spark, d).drop("vec")).withColumn("weight", r("weight"))


@query(with_tables("latent", "SELECT src, dst, round(weight, 6) AS weight FROM mut", **MUTUAL))
def mutual_similarity(spark: SparkSession, d: str) -> DataFrame:
    return stitch.mutual(sent(spark, d)).withColumn("weight", r("weight"))


@query(with_tables("latent", "SELECT src, dst, round(weight, 6) AS weight FROM resc", **RESCALED))
def edge_rescale(spark: SparkSession, d: str) -> DataFrame:
    return rescaled(spark, d).withColumn("weight", r("weight"))


@query(with_tables("latent", "SELECT src, dst, round(weight, 6) AS weight FROM nnm", **STITCHED))
def stitched_graph(spark: SparkSession, d: str) -> DataFrame:
    return stitch.stitched(strongest(spark, d), inner(spark, d), domain.latent(spark, d), K).withColumn("weight", r("weight"))


@query(with_tables("latent", f"""SELECT s1, s2, round(coalesce(w, 0) / n / {K}, 6) AS weight FROM (SELECT a.species AS s1, a.n, b.species AS s2 FROM c a, c b) LEFT JOIN
 (SELECT a.species AS s1, b.species AS s2, sum(weight) AS w FROM dk JOIN latent a ON src = a.cell JOIN latent b ON dst = b.cell WHERE a.species <> b.species GROUP BY ALL) USING (s1, s2)""", **STITCHED, c="SELECT species, count(*) AS n FROM latent GROUP BY ALL"))  # fmt: skip
def alignment_means(spark: SparkSession, d: str) -> DataFrame:
    return stitch.alignment_means(strongest(spark, d), domain.latent(spark, d), K).withColumn("weight", r("weight"))


def score_sql(n_top: int = 0) -> str:
    top = f"QUALIFY row_number() OVER (PARTITION BY c1, c2 ORDER BY w DESC, src) <= {n_top}" if n_top else ""
    n = f"least(count(*), {n_top})" if n_top else "count(*)"
    return f"""SELECT a.c AS c1, b.c AS c2, coalesce(score, 0.0) AS score FROM (SELECT DISTINCT cluster AS c FROM latent) a CROSS JOIN (SELECT DISTINCT cluster AS c FROM latent) b LEFT JOIN (
 SELECT c1, c2, max(score) AS score FROM (SELECT c1, c2, score FROM dir UNION ALL SELECT c2, c1, score FROM dir) GROUP BY ALL) s ON s.c1 = a.c AND s.c2 = b.c""".replace("dir", f"""(
 SELECT c1, c2, sum(w) / n AS score FROM (SELECT * FROM (SELECT src, a.cluster AS c1, b.cluster AS c2, sum(weight) AS w FROM knn JOIN latent a ON src = a.cell JOIN latent b ON dst = b.cell WHERE a.species <> b.species GROUP BY ALL) {top}) JOIN (SELECT cluster AS c1, {n} AS n FROM latent GROUP BY ALL) USING (c1) GROUP BY c1, c2, n)""")


def mapping(spark: SparkSession, d: str, n_top: int = 0, datasets: int = 2) -> DataFrame:
    return scores.mapping_scores(weights(spark, d, datasets), domain.latent(spark, d, datasets).drop("vec"), n_top)


@query(with_tables("latent", "SELECT c1, c2, round(score, 6) AS score FROM sc", near=NEAR, knn=WEIGHTS, sc=score_sql()))
def mapping_scores(spark: SparkSession, d: str) -> DataFrame:
    return mapping(spark, d).withColumn("score", r("score"))


@query(with_tables("latent", "SELECT c1, c2, round(score, 6) AS score FROM sc", near=NEAR, knn=WEIGHTS, sc=score_sql(5)))
def mapping_scores_ntop(spark: SparkSession, d: str) -> DataFrame:
    return mapping(spark, d, 5).withColumn("score", r("score"))


@query(with_tables("latent", """SELECT c1 AS anchor, anchor_rank, row_number() OVER (PARTITION BY c1 ORDER BY score DESC, c2) AS rank, c2 AS cluster, score
 FROM r6 JOIN (SELECT c1, row_number() OVER (ORDER BY max(score) DESC, c1) AS anchor_rank FROM r6 GROUP BY c1) USING (c1)""", near=NEAR, knn=WEIGHTS, sc=score_sql(), r6="SELECT c1, c2, round(score, 6) AS score FROM sc"))  # fmt: skip
def mapping_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: ranked partners of every cluster."""
    ranked = scores.ranked(mapping(spark, d).withColumn("score", r("score")))
    return ranked.withColumns({"anchor_rank": F.col("anchor_rank").cast("long"), "rank": F.col("rank").cast("long")})


#: A graph over customers by rule: three neighbours each.
CUSTOMER_GRAPH = "SELECT c_custkey AS src, (c_custkey * m + m) % (SELECT count(*) FROM customer) AS dst, 1.0::DOUBLE / m AS weight FROM customer, (VALUES (2), (3), (5)) t(m)"


def customer_graph(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer")
    n = F.broadcast(customers.agg(F.count(F.lit(1)).alias("n")))  # one row
    rows = customers.select("c_custkey", F.explode(F.array(*map(F.lit, (2, 3, 5)))).alias("m")).join(n)
    return rows.select(F.col("c_custkey").alias("src"), ((F.col("c_custkey") * F.col("m") + F.col("m")) % F.col("n")).alias("dst"), (1.0 / F.col("m")).alias("weight"))


AVERAGED = {
    "cg": CUSTOMER_GRAPH,
    "ed": "SELECT src, dst, weight, species FROM cg JOIN cells ON dst = cell",
    "avgd": "SELECT cell, species, gene, s / CASE WHEN t < 1e-3 THEN 1.0 ELSE t END AS value FROM (SELECT src AS cell, ed.species, gene, sum(weight * value) AS s FROM ed JOIN expr ON dst = expr.cell GROUP BY ALL) JOIN (SELECT src AS cell, species, sum(weight) AS t FROM ed GROUP BY ALL) USING (cell, species)",
}


def averaged(spark: SparkSession, d: str) -> DataFrame:
    return refine.averaged(customer_graph(spark, d), domain.expr(spark, d), domain.customers(spark, d))


@query(with_tables("expr", "SELECT cell, species, gene, round(value, 6) AS value FROM avgd", **AVERAGED))
def neighbor_avg_expr(spark: SparkSession, d: str) -> DataFrame:
    return averaged(spark, d).withColumn("value", r("value"))


CORRELATED = {
    **AVERAGED,
    "pr": "SELECT g1, g2, s1, s2 FROM homology WHERE g1 < g2",
    "dense": "SELECT g1, g2, c.cell, coalesce(a.value, 0) AS x, coalesce(b.value, 0) AS y FROM pr JOIN cells c ON c.species IN (s1, s2) LEFT JOIN avgd a ON a.cell = c.cell AND a.gene = g1 LEFT JOIN avgd b ON b.cell = c.cell AND b.gene = g2",
    "co": "SELECT g1, g2, CASE WHEN var_pop(x) > 0 AND var_pop(y) > 0 THEN corr(x, y) END AS corr FROM dense GROUP BY ALL",
}


@query(with_tables("expr homology", "SELECT g1, g2, round(corr, 6) AS corr FROM co", **CORRELATED))
def pair_correlation(spark: SparkSession, d: str) -> DataFrame:
    pairs = domain.shared_homology(spark, d).filter("g1 < g2")
    return refine.pearson(pairs, averaged(spark, d), domain.customers(spark, d)).select("g1", "g2", r("corr").alias("corr"))


@query(with_tables("expr homology", "SELECT g1, g2, split_part(g1,'_',1) AS s1, split_part(g2,'_',1) AS s2, round(corr, 6) AS weight FROM (SELECT g1, g2, corr FROM kept UNION ALL SELECT g2, g1, corr FROM kept)", **CORRELATED, kept="SELECT g1, g2, corr FROM co WHERE corr >= 0.1 AND split_part(g1,'_',2) <> '0' AND split_part(g2,'_',2) <> '0'"))
def refined_homology(spark: SparkSession, d: str) -> DataFrame:
    """Correlations of 0.1 or more; features number 0 have no weight."""
    rows = refine.refined(domain.shared_homology(spark, d), customer_graph(spark, d), domain.expr(spark, d), domain.customers(spark, d), domain.genes(spark, d), 0.1)
    return rows.withColumn("weight", r("weight"))


@query(with_tables("", """SELECT l_suppkey, round(CASE WHEN d > 0 THEN 1 - n * coalesce(a, 0) / d ELSE 0 END, 6) AS xi FROM (
 SELECT l_suppkey, sum(step) AS a, 2 * sum(l * (n - l)) AS d, max(n) AS n FROM (SELECT *, abs(r - lag(r) OVER (PARTITION BY l_suppkey ORDER BY x, id)) AS step FROM rk) GROUP BY l_suppkey)""",
    t="SELECT l_suppkey, l_orderkey AS id, sum(l_quantity) AS x, sum(l_discount * 100)::BIGINT AS y FROM lineitem GROUP BY ALL",
    rk="SELECT *, count(*) OVER (PARTITION BY l_suppkey ORDER BY y) AS r, count(*) OVER (PARTITION BY l_suppkey ORDER BY y DESC) AS l, count(*) OVER (PARTITION BY l_suppkey) AS n FROM t"))
def xi_correlation(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_suppkey", F.col("l_orderkey").alias("id")).agg(F.sum("l_quantity").alias("x"), F.round(F.sum(F.col("l_discount") * 100)).cast("long").alias("y"))
    return refine.xi(rows, ["l_suppkey"], "x", "y", ["id"]).withColumn("xi", r("xi"))


REFINED_BOTH = "SELECT g1, g2, sqrt(greatest(corr, 0) * sqrt(a.weight * b.weight)) * h.weight AS w FROM co JOIN genes a ON a.gene = g1 JOIN genes b ON b.gene = g2 JOIN homology h USING (g1, g2) WHERE corr >= 0.05 AND a.weight > 0 AND b.weight > 0"


@query(with_tables("expr homology", "SELECT g1, g2, split_part(g1,'_',1) AS s1, split_part(g2,'_',1) AS s2, round(w, 6) AS weight FROM (SELECT g1, g2, w FROM both_w UNION ALL SELECT g2, g1, w FROM both_w)", **CORRELATED, both_w=REFINED_BOTH))
def refined_homology_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Correlations joined with the features' weights and the original scores."""
    rows = refine.refined(domain.shared_homology(spark, d), customer_graph(spark, d), domain.expr(spark, d), domain.customers(spark, d), domain.genes(spark, d), 0.05, by_weight=True, by_score=True)
    return rows.withColumn("weight", r("weight"))


XI = {
    **AVERAGED,
    "pr": "SELECT g1, g2, s1, s2 FROM homology WHERE g1 < g2",
    "dense": "SELECT g1, g2, c.cell, round(coalesce(a.value, 0), 6) AS x, round(coalesce(b.value, 0), 6) AS y FROM pr JOIN cells c ON c.species IN (s1, s2) LEFT JOIN avgd a ON a.cell = c.cell AND a.gene = g1 LEFT JOIN avgd b ON b.cell = c.cell AND b.gene = g2",
    "rk": "SELECT *, count(*) OVER (PARTITION BY g1, g2 ORDER BY y) AS r, count(*) OVER (PARTITION BY g1, g2 ORDER BY y DESC) AS l, count(*) OVER (PARTITION BY g1, g2) AS n FROM dense",
}


@query(with_tables("expr homology", """SELECT g1, g2, round(CASE WHEN d > 0 THEN 1 - n * coalesce(a, 0) / d ELSE 0 END, 6) AS corr FROM (
 SELECT g1, g2, sum(step) AS a, 2 * sum(l * (n - l)) AS d, max(n) AS n FROM (SELECT *, abs(r - lag(r) OVER (PARTITION BY g1, g2 ORDER BY x, cell)) AS step FROM rk) GROUP BY g1, g2)""", **XI))  # fmt: skip
def xi_pair_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Values are rounded, so that equal ones tie in any order of summation."""
    pairs = domain.shared_homology(spark, d).filter("g1 < g2")
    return refine.xi_pairs(pairs, customer_graph(spark, d), domain.expr(spark, d), domain.customers(spark, d), 6).select("g1", "g2", r("corr").alias("corr"))


def _renamed(sql: str, **names: str) -> str:
    """The SQL with other table names."""
    for old, new in names.items():
        sql = re.sub(rf"\b{old}\b", new, sql)
    return sql


def _pass_sql(p: int, edges: str) -> dict[str, str]:
    """One pass of the loop: from ``edges`` to the strongest edges, the graph and the refined homology."""
    latent = f"lt{p}"
    names = {"latent": latent, "near": f"nr{p}", "knn": f"kn{p}", "sent": f"se{p}", "mut": f"mu{p}", "cor": f"co{p}", "f": f"ff{p}", "resc": f"re{p}"}
    across = {n: _renamed(sql, **names) for n, sql in {"near": NEAR, "knn": WEIGHTS, **{n: sql for n, sql in RESCALED.items() if n not in CAPPED}}.items()}
    return {
        f"hw{p}": f"""SELECT g1, g2, s1, s2, 0.5 + 0.5 * tanh(10 * (w - 0.5)) AS weight FROM (SELECT *, weight / CASE WHEN max(weight) OVER (PARTITION BY g1) <= 0 THEN 1 ELSE max(weight) OVER (PARTITION BY g1) END AS w FROM {edges})
 WHERE w <> 0 AND g1 IN (SELECT gene FROM genes WHERE weight > 0) AND g2 IN (SELECT gene FROM genes WHERE weight > 0)""",
        f"tr{p}": f"SELECT e.species, cell, g2 AS gene, sum(value * weight) AS value FROM sc e JOIN hw{p} ON gene = g1 WHERE s1 <> s2 GROUP BY ALL",
        f"ts{p}": f"SELECT species, gene, CASE WHEN q / n - (s / n) * (s / n) <= 0 THEN 1.0 ELSE sqrt(q / n - (s / n) * (s / n)) END AS sd FROM (SELECT species, gene, sum(value) AS s, sum(value * value) AS q FROM tr{p} GROUP BY ALL) JOIN size USING (species)",
        f"pj{p}": f"SELECT species, cell, pc, sum(x.value * ld.value) AS v FROM (SELECT * FROM sc UNION ALL SELECT e.species, cell, e.gene, value * (weight / sd) FROM tr{p} e JOIN ts{p} USING (species, gene) JOIN genes g ON g.gene = e.gene WHERE weight <> 0) x JOIN ld USING (gene) GROUP BY ALL",
        f"ct{p}": f"SELECT c.species, c.cell, cluster, m.pc, coalesce(v, 0) - mean AS v FROM cc c JOIN (SELECT species, pc, sum(v) / n AS mean FROM pj{p} JOIN size USING (species) GROUP BY species, pc, n) m USING (species) LEFT JOIN pj{p} p ON p.cell = c.cell AND p.pc = m.pc",
        latent: f"SELECT species, cell, cluster, list(v ORDER BY pc) AS vec FROM ct{p} GROUP BY ALL",
        **{names[n]: sql for n, sql in across.items()},
        f"dk{p}": f"SELECT src, dst, weight FROM re{p} JOIN cc ON dst = cell QUALIFY row_number() OVER (PARTITION BY src, species ORDER BY round(weight, 12) DESC, dst) <= {K}",
        f"nn{p}": f"SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM dk{p} UNION ALL SELECT g.src, g.dst, 1 - coalesce(u, 0) / ({K} * (SELECT count(*) - 1 FROM size)) FROM g LEFT JOIN (SELECT src, sum(weight) AS u FROM dk{p} GROUP BY src) x ON g.src = x.src) WHERE src <> dst GROUP BY ALL",
        f"ed{p}": f"SELECT src, dst, weight, species FROM nn{p} JOIN cc ON dst = cell",
        f"av{p}": f"SELECT cell, species, gene, s / CASE WHEN t < 1e-3 THEN 1.0 ELSE t END AS value FROM (SELECT src AS cell, e.species, gene, sum(weight * value) AS s FROM ed{p} e JOIN ee ON dst = ee.cell GROUP BY ALL) JOIN (SELECT src AS cell, species, sum(weight) AS t FROM ed{p} GROUP BY ALL) USING (cell, species)",
        f"cr{p}": f"SELECT g1, g2, s1, s2, CASE WHEN var_pop(x) > 1e-13 AND var_pop(y) > 1e-13 THEN greatest(corr(x, y), 0) ELSE 0 END AS weight FROM (SELECT g1, g2, s1, s2, coalesce(a.value, 0) AS x, coalesce(b.value, 0) AS y FROM hp JOIN cc c ON c.species IN (s1, s2) LEFT JOIN av{p} a ON a.cell = c.cell AND a.gene = g1 LEFT JOIN av{p} b ON b.cell = c.cell AND b.gene = g2 WHERE g1 < g2 AND g1 IN (SELECT gene FROM genes WHERE weight > 0) AND g2 IN (SELECT gene FROM genes WHERE weight > 0)) GROUP BY ALL",
        f"rf{p}": f"SELECT * FROM cr{p} WHERE weight <> 0 UNION ALL SELECT g2, g1, s2, s1, weight FROM cr{p} WHERE weight <> 0",
    }


SESSION = {
    "cc": "SELECT species, cell::VARCHAR AS cell, cluster FROM cells",
    "ee": "SELECT species, cell::VARCHAR AS cell, gene, value FROM expr",
    "size": "SELECT species, count(*) AS n FROM cc GROUP BY species",
    "hp": "SELECT g1, g2, s1, s2, weight FROM (SELECT *, max(weight) OVER (PARTITION BY g1) AS m1, max(weight) OVER (PARTITION BY g2) AS m2 FROM homology) WHERE weight >= 0.25 * m1 OR weight >= 0.25 * m2",
    "stats": STATS,
    "sc": _renamed(SCALED, expr="ee"),
    "ld": "SELECT gene, pc + (SELECT max(pc) + 1 FROM loadings) * (SELECT count(*) FROM size WHERE species < split_part(gene, '_', 1)) AS pc, value FROM loadings",
    "cg": CUSTOMER_GRAPH,
    "g": "SELECT src::VARCHAR AS src, dst::VARCHAR AS dst, weight FROM cg JOIN cells a ON src = a.cell JOIN cells b ON dst = b.cell WHERE a.species = b.species",
    **{n: _renamed(sql, latent="cc") for n, sql in CAPPED.items() if n != "g"},
    **{n: sql for n, sql in _pass_sql(1, "hp").items()},
    **{n: sql for n, sql in _pass_sql(2, "rf1").items() if n[:2] not in ("nn", "ed", "av", "cr", "rf")},
    "dir": f"SELECT c1, c2, sum(w) / n / {K} AS score FROM (SELECT a.species || '_' || a.cluster AS c1, b.species || '_' || b.cluster AS c2, weight AS w FROM dk2 JOIN cc a ON src = a.cell JOIN cc b ON dst = b.cell WHERE a.species <> b.species) JOIN (SELECT species || '_' || cluster AS c1, count(*) AS n FROM cc GROUP BY ALL) USING (c1) GROUP BY c1, c2, n",
    "lab": "SELECT DISTINCT species || '_' || cluster AS c FROM cc",
}


@query(with_tables("expr genes homology loadings", "SELECT a.c AS c1, b.c AS c2, round(coalesce(score, 0.0), 6) AS score FROM lab a CROSS JOIN lab b LEFT JOIN (SELECT c1, c2, max(score) AS score FROM (SELECT * FROM dir UNION ALL SELECT c2, c1, score FROM dir) GROUP BY ALL) s ON s.c1 = a.c AND s.c2 = b.c", **SESSION))
def mapping_session(spark: SparkSession, d: str) -> DataFrame:
    """The whole loop, two passes with a refinement between: scores of the stitched graph."""
    expr, cells, genes = domain.expr(spark, d), domain.customers(spark, d), domain.genes(spark, d)
    loadings = domain.loadings(spark, d).withColumn("species", F.split_part("gene", F.lit("_"), F.lit(1)))
    cells = cells.withColumn("cell", F.col("cell").cast("string"))
    home = cells.select(F.col("cell").alias("src"), F.col("species").alias("a")), cells.select(F.col("cell").alias("dst"), F.col("species").alias("b"))
    own = customer_graph(spark, d).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "weight")
    own = own.join(home[0], "src").join(home[1], "dst").filter("a = b").select("src", "dst", "weight")
    m = Mapping(expr.withColumn("cell", F.col("cell").cast("string")), cells, genes, own, loadings, edges=domain.shared_homology(spark, d))
    return m.run(iterations=2, hops=2, k=K).mapping_scores().withColumn("score", r("score"))
