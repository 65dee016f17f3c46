"""Queries on markers, linked features, enrichment, triangles, paralogs and the tables behind drawings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.operators import datasets, enrichment, gene_pairs, links, markers, paralogs, scores, triangles
from crossweave.plans import domain
from crossweave.plans.catalogue import query
from crossweave.plans.domain import latent_sql, table, with_tables
from crossweave.plans.queries_base import BEST, GRAPH, STATS, graph
from crossweave.plans.queries_mapping import CUSTOMER_GRAPH, NEAR, WEIGHTS, customer_graph, mapping, score_sql

#: Mapping scores count from here on in the queries.
SCORE = 0.12


def r(column, digits: int = 6):
    return F.round(column, digits)


# The pooled clusters of the marker tests: nations mod 4, so that each has many customers.
POOLED = "SELECT species, cell, species || '_' || (split_part(cluster,'_',2)::INT % 4) AS cluster FROM cells"


def pooled(spark: SparkSession, d: str) -> DataFrame:
    cells = domain.customers(spark, d)
    return cells.withColumn("cluster", F.concat("species", F.lit("_"), (F.split_part("cluster", F.lit("_"), F.lit(2)).cast("int") % 4).cast("string")))


MARKERS = {
    "pc": POOLED,
    "sized": "SELECT species, cluster, count(*) AS m FROM pc GROUP BY ALL HAVING count(*) > 1",
    "pt": "SELECT pc.* FROM pc JOIN sized USING (species, cluster)",
    "den": "SELECT pt.species, pt.cell, pt.cluster, g.gene, coalesce(value, 0) AS v FROM pt JOIN genes g ON g.species = pt.species LEFT JOIN expr e ON e.cell = pt.cell AND e.gene = g.gene",
    "rk": "SELECT *, rank() OVER (PARTITION BY gene ORDER BY v) + (count(*) OVER (PARTITION BY gene, v) - 1) / 2 AS rk FROM den",
    "zs": """SELECT species, gene, cluster, CASE WHEN m < n THEN (rs - m * (n + 1) / 2) / sqrt(m * (n - m) * (n + 1) / 12) ELSE 0.0 END AS z FROM
 (SELECT species, gene, cluster, sum(rk) AS rs, count(*)::DOUBLE AS m FROM rk GROUP BY ALL) JOIN (SELECT species, count(*)::DOUBLE AS n FROM pt GROUP BY ALL) USING (species)""",
}


def marker_table(spark: SparkSession, d: str) -> DataFrame:
    return markers.markers(domain.expr(spark, d), pooled(spark, d), domain.genes(spark, d))


@query(with_tables("expr genes", "SELECT species, gene, cluster, round(z, 6) AS z FROM zs", **MARKERS))
def marker_zscores(spark: SparkSession, d: str) -> DataFrame:
    return markers.marker_scores(domain.expr(spark, d), pooled(spark, d), domain.genes(spark, d)).withColumn("z", r("z"))


# erfc(x) = 1 - 2 / sqrt(pi) exp(-x²) Σ 2^n x^(2n + 1) / (2n + 1)!!, whose terms are all positive.
ERFC = """CASE WHEN x = 0 THEN 1.0 WHEN x > 6 THEN 0.0 ELSE greatest(0.0, 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 160), lambda n: exp(2 * n * ln(2) + (2 * n + 1) * ln(x) - x * x - lgamma(2 * n + 2) + lgamma(n + 1))))) END"""


@query(with_tables("expr genes", f"""SELECT species, gene, cluster, round(greatest(z, 0), 6) AS score, round(CASE WHEN z < 0 THEN 1.0 ELSE {ERFC} END, 6) AS pval FROM (SELECT *, abs(z) / sqrt(2) AS x FROM zs)
 UNION ALL SELECT species, gene, cluster, 0.0, 1.0 FROM genes JOIN (SELECT species, cluster FROM pc GROUP BY ALL HAVING count(*) = 1) USING (species)""", **MARKERS))
def marker_pvalues(spark: SparkSession, d: str) -> DataFrame:
    return marker_table(spark, d).select("species", "gene", "cluster", r("score").alias("score"), r("pval").alias("pval"))


@query(with_tables("expr genes", "SELECT gene, arg_max(cluster, (greatest(z, 0), cluster)) AS cluster FROM zs GROUP BY gene", **MARKERS))
def marker_best_cluster(spark: SparkSession, d: str) -> DataFrame:
    """No p-value is below 0, so each feature's best cluster is left."""
    return triangles.cell_types(marker_table(spark, d), -1.0).withColumnRenamed("types", "cluster")


#: Clusters are mapped from this score on in the feature-pair queries.
PAIR_SCORE = 0.0512345
PAIRS = {
    "pc": POOLED,
    "stats": STATS,
    "cg": CUSTOMER_GRAPH,
    "dir": "SELECT a.cluster AS c1, b.cluster AS c2, a.species AS s1, b.species AS s2, sum(weight) / any_value(m) AS score FROM cg JOIN pc a ON src = a.cell JOIN pc b ON dst = b.cell JOIN (SELECT cluster, count(*) AS m FROM pc GROUP BY ALL) z ON z.cluster = a.cluster WHERE a.species <> b.species GROUP BY ALL",
    "cl": f"SELECT c1, c2, s1, s2 FROM (SELECT * FROM dir UNION ALL SELECT c2, c1, s2, s1, score FROM dir) WHERE s1 < s2 GROUP BY ALL HAVING max(score) >= {PAIR_SCORE}",
    "sdz": "SELECT e.cell, e.gene, (value - mean) / sd AS value FROM expr e JOIN stats s ON s.species = e.species AND s.gene = e.gene WHERE value > mean",
    "bo": "SELECT a.species AS s1, a.cluster AS c1, src, b.species AS s2, b.cluster AS c2, dst FROM (SELECT src, dst FROM cg UNION SELECT dst, src FROM cg) JOIN pc a ON src = a.cell JOIN pc b ON dst = b.cell WHERE a.species < b.species",
    "lk": "SELECT DISTINCT c1, c2, src AS cell, 1 AS side FROM bo UNION SELECT DISTINCT c1, c2, dst, 2 FROM bo",
    "nn": "SELECT c1, c2, count(*) FILTER (WHERE side = 1) AS n1, count(*) FILTER (WHERE side = 2) AS n2 FROM lk GROUP BY ALL",
    "sm": "SELECT c1, c2, side, gene, sum(value) AS s FROM lk JOIN sdz USING (cell) GROUP BY ALL",
    "fullp": """SELECT cl.c1, cl.c2, g1, g2, coalesce(x.s, 0) / n1 AS a, coalesce(y.s, 0) / n2 AS b FROM cl JOIN nn ON nn.c1 = cl.c1 AND nn.c2 = cl.c2 JOIN homology h ON h.s1 = cl.s1 AND h.s2 = cl.s2
 LEFT JOIN sm x ON x.c1 = cl.c1 AND x.c2 = cl.c2 AND x.side = 1 AND x.gene = g1 LEFT JOIN sm y ON y.c1 = cl.c1 AND y.c2 = cl.c2 AND y.side = 2 AND y.gene = g2""",
    "rated": """SELECT *, greatest((a - avg(a) OVER w) / CASE WHEN stddev_pop(a) OVER w <= 0 THEN 1.0 ELSE stddev_pop(a) OVER w END, 0) * greatest((b - avg(b) OVER w) / CASE WHEN stddev_pop(b) OVER w <= 0 THEN 1.0 ELSE stddev_pop(b) OVER w END, 0) / count(*) OVER w AS raw FROM fullp WINDOW w AS (PARTITION BY c1, c2)""",
    "above": "SELECT cluster, gene FROM (SELECT cluster, gene, count(*) AS k FROM sdz JOIN pc USING (cell) GROUP BY ALL) JOIN (SELECT cluster, count(*) AS m FROM pc GROUP BY ALL) USING (cluster) WHERE k / m > 0.05",
    "ps": """SELECT c1, c2, g1, g2, CASE WHEN w1.weight >= 0.2 AND w2.weight >= 0.2 AND (c1, g1) IN (SELECT (cluster, gene) FROM above) AND (c2, g2) IN (SELECT (cluster, gene) FROM above) THEN raw ELSE 0.0 END AS score
 FROM rated JOIN genes w1 ON g1 = w1.gene JOIN genes w2 ON g2 = w2.gene""",
}


def finder(spark: SparkSession, d: str) -> gene_pairs.GenePairFinder:
    cells, edges = pooled(spark, d), customer_graph(spark, d)
    return gene_pairs.GenePairFinder(edges, domain.shared_homology(spark, d), domain.expr(spark, d), cells, domain.genes(spark, d), scores.mapping_scores(edges, cells))


@query(with_tables("expr genes homology", "SELECT c1, c2, g1, g2, round(score, 6) AS score FROM ps", **PAIRS))
def linked_gene_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All homologous pairs of all mapped pairs of clusters."""
    return finder(spark, d).pair_scores(PAIR_SCORE).withColumn("score", r("score"))


FOUND = {
    **PAIRS,
    **{k: v for k, v in MARKERS.items() if k != "pc"},
    "best": "SELECT *, row_number() OVER (PARTITION BY c1, c2 ORDER BY round(score, 12) DESC, g1, g2) AS rank FROM ps",
    "found": "SELECT c1, c2, g1 || ';' || g2 AS pair, g1, g2, rank, score FROM best JOIN zs a ON a.cluster = c1 AND a.gene = g1 JOIN zs b ON b.cluster = c2 AND b.gene = g2 WHERE rank <= 1000 AND a.z > 0.6744897501960817 AND b.z > 0.6744897501960817",
}


def found(spark: SparkSession, d: str) -> DataFrame:
    """The best pairs (1,000, the default) whose features are markers at p < 0.5 (z over 0.6745), of all mapped pairs of clusters."""
    return finder(spark, d).find_all(align_thr=PAIR_SCORE, thr=0.5)


@query(with_tables("expr genes homology", "SELECT c1, c2, pair, rank, round(score, 6) AS score FROM found", **FOUND))
def find_all_pairs(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, d).select("c1", "c2", "pair", F.col("rank").cast("long").alias("rank"), r("score").alias("score"))


@query(with_tables("expr genes homology", "SELECT c1, c2, g1 AS gene, min(rank) AS rank FROM found GROUP BY ALL", **FOUND))
def find_all_unique_genes(spark: SparkSession, d: str) -> DataFrame:
    return gene_pairs.unique_genes(found(spark, d)).withColumn("rank", F.col("rank").cast("long"))


ENRICHED = """SELECT node, term, b, least(sum(exp(lgamma(m+1)-lgamma(x+1)-lgamma(m-x+1)+lgamma(nn-m+1)-lgamma(n-x+1)-lgamma(nn-m-n+x+1)-lgamma(nn+1)+lgamma(n+1)+lgamma(nn-n+1))), 1) AS p, genes
 FROM (SELECT o.*, n, m, (SELECT count(DISTINCT gene) FROM gs) AS nn, unnest(range(b, least(n, m) + 1)) AS x FROM (
  SELECT node, term, count(*) AS b, string_agg(gene, ';' ORDER BY gene) AS genes FROM tg JOIN gs USING (gene) GROUP BY ALL) o
  JOIN (SELECT node, count(*) AS n FROM tg WHERE gene IN (SELECT gene FROM gs) GROUP BY ALL) USING (node) JOIN (SELECT term, count(*) AS m FROM gs GROUP BY ALL) USING (term))
 WHERE n - x <= nn - m GROUP BY ALL"""


#: q by rank of p among a node's terms; p that differ by rounding alone are ties, which go by term.
RATED = "SELECT *, p * count(*) OVER (PARTITION BY node) / row_number() OVER (PARTITION BY node ORDER BY round(ln(greatest(p, 1e-300)), 9), term) AS q, row_number() OVER (PARTITION BY node ORDER BY round(ln(greatest(p, 1e-300)), 9), term) AS rank FROM en"


@query(with_tables("", "SELECT node, term, b AS n_overlap, round(p, 6) AS p, round(q, 6) AS q, rank, genes FROM rt",
    gs="SELECT DISTINCT source AS term, doc_id::VARCHAR AS gene FROM documents UNION SELECT 'lang_' || lang, doc_id::VARCHAR FROM documents", tg="SELECT DISTINCT 'q' || quality AS node, doc_id::VARCHAR AS gene FROM labels", en=ENRICHED, rt=RATED))
def go_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Terms are sources and languages, genes are documents, targets those of each quality; no thresholds."""
    docs = table(spark, d, "documents").select("source", "lang", F.col("doc_id").cast("string").alias("gene"))
    sets = docs.select(F.col("source").alias("term"), "gene").unionByName(docs.select(F.concat(F.lit("lang_"), "lang").alias("term"), "gene"))
    targets = table(spark, d, "labels").select(F.concat(F.lit("q"), F.col("quality").cast("string")).alias("node"), F.col("doc_id").cast("string").alias("gene"))
    rows = enrichment.go_enrichment(targets, sets, None, None)
    return rows.select("node", "term", "n_overlap", r("p").alias("p"), r("q").alias("q"), F.col("rank").cast("long").alias("rank"), "genes")


@query(with_tables("", "SELECT node, term, b AS n_overlap, round(p, 6) AS p, rank FROM rt WHERE q < 0.9 AND p < 0.3", gs="SELECT DISTINCT 'su_' || l_suppkey AS term, l_partkey::VARCHAR AS gene FROM lineitem",
    tg="SELECT DISTINCT 'n_' || c_nationkey AS node, l_partkey::VARCHAR AS gene FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey", en=ENRICHED, rt=RATED))
def go_enrichment_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Terms are suppliers, genes are parts, targets what each nation bought."""
    lines, orders, customers = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "customer")
    gene = F.col("l_partkey").cast("string").alias("gene")
    sets = lines.select(F.concat(F.lit("su_"), F.col("l_suppkey").cast("string")).alias("term"), gene)
    bought = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    targets = bought.select(F.concat(F.lit("n_"), F.col("c_nationkey").cast("string")).alias("node"), gene)
    rows = enrichment.go_enrichment(targets, sets, 0.9, 0.3)
    return rows.select("node", "term", "n_overlap", r("p").alias("p"), F.col("rank").cast("long").alias("rank"))


@query(with_tables("expr genes homology", "SELECT node, term, round(-log10(p), 6) + 0.0 AS enrichment, b AS n_genes, genes FROM en WHERE term <> 'S'", **FOUND,
    gs="SELECT DISTINCT upper(unnest(regexp_extract_all(p_type, '\\p{L}'))) AS term, species || '_' || (p_partkey % 100) AS gene FROM part, (SELECT DISTINCT species FROM cells)",
    tg="SELECT c1 AS node, g1 AS gene FROM found UNION SELECT c2, g2 FROM found", en=ENRICHED))
def functional_enrichment(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    species = domain.customers(spark, d).select("species").distinct()
    packed = parts.select(F.upper("p_type").alias("packed"), (F.col("p_partkey") % 100).cast("string").alias("gene")).join(F.broadcast(species))  # five segments
    made = enrichment.FunctionalEnrichment(found(spark, d), enrichment.sets_from(packed)).calculate()
    return made.select("node", "term", r("enrichment").alias("enrichment"), "n_genes", "genes")


@query(with_tables("genes", "SELECT species, gene, coalesce(packed, '') AS packed FROM genes LEFT JOIN (SELECT species, species || '_' || p_partkey AS gene, p_type AS packed FROM part, (SELECT DISTINCT species FROM cells) WHERE p_size > 5) USING (species, gene)"))
def annotation_reindex(spark: SparkSession, d: str) -> DataFrame:
    """Features of each segment with the type of the part of their number, empty where it has none (small parts aren't annotated)."""
    species = domain.customers(spark, d).select("species").distinct()
    known = table(spark, d, "part").filter("p_size > 5").select(F.col("p_partkey").cast("string").alias("gene"), F.col("p_type").alias("packed")).join(F.broadcast(species))  # five segments
    return enrichment.annotated(domain.genes(spark, d), known)


TRIANGLE = "SELECT e.c1 AS a, e.c2 AS b, f.c2 AS c, e.score AS w_ab, g.score AS w_ac, f.score AS w_bc FROM st e JOIN st f ON e.c2 = f.c1 JOIN st g ON g.c1 = e.c1 AND g.c2 = f.c2"


@query(with_tables("", "SELECT a, b, c, round(w_ab, 6) AS w_ab, round(w_ac, 6) AS w_ac, round(w_bc, 6) AS w_bc FROM tr", latent=latent_sql(3), near=NEAR, knn=WEIGHTS, sc=score_sql(),
    st=f"SELECT c1, c2, score FROM sc WHERE score > {SCORE} AND c1 < c2 AND split_part(c1,'_',1) <> split_part(c2,'_',1)", tr=TRIANGLE))
def cluster_triangles(spark: SparkSession, d: str) -> DataFrame:
    found = triangles.cluster_triangles(mapping(spark, d, datasets=3), domain.latent(spark, d, 3).drop("vec"), SCORE)
    return found.select("a", "b", "c", *[r(w).alias(w) for w in ("w_ab", "w_ac", "w_bc")])


# Three kinds of entities: parts, suppliers, customers; an edge's weight is the share of its largest price.
KINDS = """SELECT 'pa_' || l_partkey AS x, 'su_' || l_suppkey AS y, max(l_quantity) / 50 AS w FROM lineitem GROUP BY ALL
 UNION ALL SELECT 'cu_' || o_custkey, 'pa_' || l_partkey, max(l_quantity) / 50 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL
 UNION ALL SELECT 'cu_' || o_custkey, 'su_' || l_suppkey, max(l_quantity) / 50 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL"""


def kinds(spark: SparkSession, d: str) -> DataFrame:
    from crossweave.operators.homology import symmetric

    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").cast("string").alias("p"), F.col("l_suppkey").cast("string").alias("s"), (F.col("l_quantity") / 50).alias("q"))
    full = lines.join(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("c")), F.col("l_orderkey") == F.col("o_orderkey"))
    part, supplier, customer = F.concat(F.lit("pa_"), "p"), F.concat(F.lit("su_"), "s"), F.concat(F.lit("cu_"), "c")
    edge = lambda df, x, y: df.groupBy(x.alias("g1"), y.alias("g2")).agg(F.max("q").alias("weight"))
    return symmetric(edge(lines, part, supplier).unionByName(edge(full, customer, part)).unionByName(edge(full, customer, supplier)))


@query(with_tables("", """SELECT e.x AS a, f.x AS b, f.y AS c, round(e.w, 6) AS w_ab, round(g.w, 6) AS w_ac, round(f.w, 6) AS w_bc, round(least(e.w, f.w, g.w), 6) AS min_corr
 FROM ko e JOIN ko f ON e.y = f.x JOIN ko g ON g.x = e.x AND g.y = f.y""", k=KINDS, ko="SELECT * FROM k WHERE w > 0.97 AND (split_part(x,'_',2)::INT + split_part(y,'_',2)::INT) % 3 = 0"))  # fmt: skip
def gene_triangles(spark: SparkSession, d: str) -> DataFrame:
    """Orthologs are edges whose numbers add up to a multiple of three."""
    edges = kinds(spark, d)
    number = lambda g: F.split_part(g, F.lit("_"), F.lit(2)).cast("int")
    orthologs = edges.filter((number("g1") + number("g2")) % 3 == 0).select(F.col("g1").alias("a"), F.col("g2").alias("b"))
    found = triangles.gene_triangles(edges, orthologs, 0.97)
    return found.select("a", "b", "c", *[r(w).alias(w) for w in ("w_ab", "w_ac", "w_bc", "min_corr")])


SUBSTITUTED = {
    "best": BEST,
    "g": GRAPH,
    "mx": "SELECT g1, g2, weight / (SELECT max(weight) FROM g) AS weight FROM g",
    "orth": "SELECT DISTINCT least(g1, g2) AS a, greatest(g1, g2) AS b FROM g WHERE split_part(g1,'_',2)::INT % 10 = split_part(g2,'_',2)::INT % 10",
    "para": "SELECT DISTINCT a, b FROM (SELECT least(g1, g2) AS a, greatest(g1, g2) AS b FROM g) WHERE (a, b) NOT IN (SELECT (a, b) FROM orth)",
    "o2": "SELECT a AS x, b AS o FROM orth UNION SELECT b, a FROM orth",
    "p2": "SELECT a AS x, b AS p FROM para UNION SELECT b, a FROM para",
}


@query(with_tables("hits", """SELECT x || ';' || o AS ortholog_pair, x || ';' || p AS paralog_pair, round(coalesce(m1.weight, 0), 6) AS ortholog_corr, round(coalesce(m2.weight, 0), 6) AS paralog_corr, round(coalesce(m2.weight, 0) - coalesce(m1.weight, 0), 6) AS corr_diff
 FROM o2 JOIN p2 USING (x) LEFT JOIN mx m1 ON m1.g1 = x AND m1.g2 = o LEFT JOIN mx m2 ON m2.g1 = x AND m2.g2 = p WHERE coalesce(m2.weight, 0) - coalesce(m1.weight, 0) > 0.3""", **SUBSTITUTED))  # fmt: skip
def paralog_substitutions(spark: SparkSession, d: str) -> DataFrame:
    edges = graph(spark, d)
    most = edges.agg(F.max("weight").alias("m"))
    corr = edges.join(F.broadcast(most)).select("g1", "g2", "s1", "s2", (F.col("weight") / F.col("m")).alias("weight"))  # one row
    number = lambda g: F.split_part(g, F.lit("_"), F.lit(2)).cast("int")
    orthologs = corr.filter(number("g1") % 10 == number("g2") % 10).select(F.col("g1").alias("a"), F.col("g2").alias("b"))
    rows = paralogs.substitutions(corr, orthologs, threshold=0.3)
    return rows.select("ortholog_pair", "paralog_pair", *[r(c).alias(c) for c in ("ortholog_corr", "paralog_corr", "corr_diff")])


@query(with_tables("", """SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM (SELECT a AS x, b AS y FROM o UNION ALL SELECT p.b, q.b FROM (SELECT a, b FROM p UNION SELECT b, a FROM p) p JOIN (SELECT a, b FROM o UNION SELECT b, a FROM o) q ON p.a = q.a WHERE split_part(p.a,'_',1) = split_part(p.b,'_',1)) WHERE x <> y""",
    o="SELECT DISTINCT 'pa_' || l_partkey AS a, 'su_' || l_suppkey AS b FROM lineitem", p="SELECT 'pa_' || p_partkey AS a, 'pa_' || (p_partkey * 7 % (SELECT count(*) FROM part)) AS b FROM part"))
def paralog_closure(spark: SparkSession, d: str) -> DataFrame:
    name = lambda kind, column: F.concat(F.lit(f"{kind}_"), column.cast("string"))
    orthologs = table(spark, d, "lineitem").select(name("pa", F.col("l_partkey")).alias("a"), name("su", F.col("l_suppkey")).alias("b"))
    parts = table(spark, d, "part")
    n = F.broadcast(parts.agg(F.count(F.lit(1)).alias("n")))  # one row
    own = parts.join(n).select(name("pa", F.col("p_partkey")).alias("a"), name("pa", F.col("p_partkey") * 7 % F.col("n")).alias("b"))
    return paralogs.propagated(orthologs, own)


@query(with_tables("", f"SELECT source, target, round(score, 6) AS value FROM (SELECT CASE WHEN substr(c1,2,1) = '1' THEN c2 ELSE c1 END AS source, CASE WHEN substr(c1,2,1) = '1' THEN c1 ELSE c2 END AS target, score FROM sc WHERE c1 < c2 AND score >= {SCORE} AND ('s1' IN (split_part(c1,'_',1), split_part(c2,'_',1))) AND split_part(c1,'_',1) <> split_part(c2,'_',1)) t WHERE split_part(source,'_',1) = 's2' UNION ALL SELECT c2, c1, round(score, 6) FROM sc WHERE false UNION ALL SELECT CASE WHEN split_part(c1,'_',1) = 's1' THEN c1 ELSE c2 END, CASE WHEN split_part(c1,'_',1) = 's1' THEN c2 ELSE c1 END, round(score, 6) FROM sc WHERE c1 < c2 AND score >= {SCORE} AND split_part(c1,'_',1) = 's0' AND split_part(c2,'_',1) = 's1'", latent=latent_sql(3), near=NEAR, knn=WEIGHTS, sc=score_sql()))
def sankey_links(spark: SparkSession, d: str) -> DataFrame:
    """Datasets in the order s2, s1, s0."""
    return links.sankey_links(mapping(spark, d, datasets=3), ["s2", "s1", "s0"], SCORE).withColumn("value", r("value"))


@query(with_tables("expr", """SELECT cell, round(x, 6) AS au, round(y, 6) AS bu, round(least(x, y) / CASE WHEN mx <= 0 THEN 1.0 ELSE mx END, 6) AS overlap FROM (SELECT *, max(least(x, y)) OVER () AS mx FROM (
 SELECT src AS cell, CASE WHEN coalesce(max(v) FILTER (WHERE gene = 'au_5'), 0) < 0.1 THEN 0.0 ELSE max(v) FILTER (WHERE gene = 'au_5') END AS x, CASE WHEN coalesce(max(v) FILTER (WHERE gene = 'bu_5'), 0) < 0.1 THEN 0.0 ELSE max(v) FILTER (WHERE gene = 'bu_5') END AS y
 FROM (SELECT src, gene, sum(weight * value) / t AS v FROM cg JOIN expr ON dst = cell JOIN (SELECT src, sum(weight) AS t FROM cg GROUP BY src) USING (src) WHERE gene IN ('au_5', 'bu_5') GROUP BY src, gene, t) GROUP BY src) WHERE greatest(x, y) > 0)""", cg=CUSTOMER_GRAPH))  # fmt: skip
def expression_overlap(spark: SparkSession, d: str) -> DataFrame:
    rows = links.expression_overlap(customer_graph(spark, d), domain.expr(spark, d), {"au": "au_5", "bu": "bu_5"})
    return rows.select("cell", r("au").alias("au"), r("bu").alias("bu"), r("overlap").alias("overlap"))


@query("""SELECT 'cu' AS species, 'batch1' AS batch, c_custkey AS cell, c_nationkey::VARCHAR AS cu_label, 'unassigned' AS su_label, 'unassigned' AS pa_label FROM customer
 UNION ALL SELECT 'su', 'batch2', s_suppkey, 'unassigned', s_nationkey::VARCHAR, 'unassigned' FROM supplier UNION ALL SELECT 'pa', 'batch3', p_partkey, 'unassigned', 'unassigned', p_brand FROM part""")
def concat_datasets(spark: SparkSession, d: str) -> DataFrame:
    tables = {
        "cu": table(spark, d, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_nationkey").alias("label")),
        "su": table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell"), F.col("s_nationkey").alias("label")),
        "pa": table(spark, d, "part").select(F.col("p_partkey").alias("cell"), F.col("p_brand").alias("label")),
    }
    return datasets.concatenated(tables, ["label"])


@query(with_tables("cells", "SELECT species, cell, cluster FROM cells WHERE species IN ('au', 'bu')"))
def species_subset(spark: SparkSession, d: str) -> DataFrame:
    return datasets.of_species(domain.customers(spark, d), ["au", "bu"])


@query(with_tables("latent", f"SELECT DISTINCT a.c AS c1, b.c AS c2 FROM (SELECT DISTINCT cluster AS c, species AS s FROM latent) a, (SELECT DISTINCT cluster AS c, species AS s FROM latent) b, sc WHERE a.s < b.s AND sc.c1 = a.c AND sc.c2 = b.c AND score >= {SCORE} AND (a.c = 's0_3' OR b.c = 's0_3')", near=NEAR, knn=WEIGHTS, sc=score_sql()))
def clusters_connected(spark: SparkSession, d: str) -> DataFrame:
    """The mapped pairs that cluster s0_3 is in."""
    return gene_pairs.mapped_clusters(mapping(spark, d), domain.latent(spark, d).drop("vec"), SCORE, "s0_3").select("c1", "c2")


@query(with_tables("expr genes", "SELECT gene, string_agg(cluster, ';' ORDER BY cluster) AS types FROM (SELECT gene, arg_max(cluster, (greatest(z, 0), cluster)) AS cluster FROM zs GROUP BY gene UNION SELECT gene, cluster FROM zs WHERE z > 2.5758293035489004) GROUP BY gene", **MARKERS))
def gene_cell_types(spark: SparkSession, d: str) -> DataFrame:
    """Each feature's best cluster and those with p <= 0.01 (z over 2.5758)."""
    return triangles.cell_types(marker_table(spark, d), 0.01)
