"""Queries on names, pairs, hits, homology and expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.functions import numeric, text
from crossweave.operators import datasets, expression, homology, linalg, pairs, paralogs
from crossweave.plans import domain
from crossweave.plans.catalogue import query
from crossweave.plans.domain import table, with_tables
from crossweave.sources import checkpoint, hits, store

#: Hits count at this e-value in the queries.
EVALUE = 0.05


def r(column, digits: int = 6):
    return F.round(column, digits)


@query("SELECT p_partkey, CASE WHEN split_part(p_name,'_',1) = 'pa' THEN p_name ELSE 'pa_' || p_name END AS qualified, 'pa_' || p_brand AS kept FROM part")
def prefix_qualify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.qualify(F.col("p_name"), F.lit("pa")).alias("qualified"), text.qualify(F.concat(F.lit("pa_"), "p_brand"), F.lit("pa")).alias("kept"))


@query("SELECT DISTINCT 'pa_' || l_partkey || ';' || 'su_' || l_suppkey AS pair, 'pa_' || l_partkey AS a, 'su_' || l_suppkey AS b FROM lineitem")
def pair_encode_decode(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(text.encode_pair(F.concat(F.lit("pa_"), F.col("l_partkey").cast("string")), F.concat(F.lit("su_"), F.col("l_suppkey").cast("string"))).alias("pair")).distinct()
    a, b = text.decode_pair(F.col("pair"))
    return rows.select("pair", a.alias("a"), b.alias("b"))


@query("""SELECT p_partkey, split_part(p_name,' ',1) AS first, split_part(p_name,' ',least(6, len(string_split(p_name,' ')))) AS clamped,
 coalesce(string_split(p_name,' ')[1],'') AS part0, coalesce(string_split(p_name,' ')[2],'') AS part1, coalesce(string_split(p_name,' ')[3],'') AS part2 FROM part""")
def split_clamped(spark: SparkSession, d: str) -> DataFrame:
    p0, p1, p2 = text.parts(F.col("p_name"), " ", 3)
    return table(spark, d, "part").select("p_partkey", text.part(F.col("p_name"), " ", 0).alias("first"), text.part(F.col("p_name"), " ", 5).alias("clamped"), p0.alias("part0"), p1.alias("part1"), p2.alias("part2"))


@query("SELECT s_suppkey, 'Supplier_' || s_suppkey AS bare, 'su' AS species FROM supplier")
def strip_prefix(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("su_Supplier_"), F.col("s_suppkey").cast("string"))
    return table(spark, d, "supplier").select("s_suppkey", text.strip_species(name).alias("bare"), text.species_of(name).alias("species"))


@query("SELECT l_suppkey, string_agg(v, ';' ORDER BY v) AS genes, count(*) AS n FROM (SELECT DISTINCT l_suppkey, 'pa_' || l_partkey AS v FROM lineitem) GROUP BY l_suppkey")
def group_to_arrays(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_suppkey", F.concat(F.lit("pa_"), F.col("l_partkey").cast("string")).alias("v")).distinct()
    return pairs.to_arrays(rows, "l_suppkey", "v").select("l_suppkey", F.array_join("values", ";").alias("genes"), F.size("values").cast("long").alias("n"))


@query("SELECT l_suppkey, string_agg(v, ';' ORDER BY v) AS genes FROM (SELECT l_suppkey, 'l' || l_linenumber AS v FROM lineitem UNION ALL SELECT l_suppkey, 'f' || l_returnflag FROM lineitem) GROUP BY l_suppkey")
def group_columns_to_arrays(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_suppkey", F.concat(F.lit("l"), F.col("l_linenumber").cast("string")).alias("a"), F.concat(F.lit("f"), F.col("l_returnflag")).alias("b"))
    return pairs.to_arrays(rows, "l_suppkey", "a", "b").select("l_suppkey", F.array_join("values", ";").alias("genes"))


@query("SELECT DISTINCT least(x.l_partkey, y.l_partkey) AS a, greatest(x.l_partkey, y.l_partkey) AS b FROM lineitem x JOIN lineitem y USING (l_orderkey) WHERE x.l_partkey <> y.l_partkey")
def canonical_pairs(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    one, two = (lines.select("l_orderkey", F.col("l_partkey").alias(n)).distinct() for n in ("x", "y"))
    return pairs.canonical(one.join(two, "l_orderkey").filter("x < y"), "x", "y")


@query("SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE (least(l_partkey, l_suppkey), greatest(l_partkey, l_suppkey)) NOT IN (SELECT (least(l_partkey, l_suppkey), greatest(l_partkey, l_suppkey)) FROM lineitem WHERE l_returnflag = 'R')")
def pairs_without(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), "l_returnflag")
    return pairs.without(lines, lines.filter("l_returnflag = 'R'"))


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS term FROM part")
def explode_delimited(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.explode(text.unpack(F.col("p_name"), " ")).alias("term"))


@query(r"SELECT p_partkey, unnest(regexp_extract_all(p_brand || p_type, '\p{L}')) AS term FROM part")
def explode_letters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.explode(text.unpack(F.concat("p_brand", "p_type"), "")).alias("term"))


@query("SELECT p_partkey, upper(substr(p_type,1,1)) AS term, description FROM part LEFT JOIN (VALUES ('E','Amino acid transport and metabolism'),('S','Function unknown'),('P','Inorganic ion transport and metabolism'),('M','Cell wall membrane/envelope biogenesis'),('L','Replication, recombination, and repair')) k(term, description) ON upper(substr(p_type,1,1)) = term")
def kog_dimension_join(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.upper(F.substring("p_type", 1, 1)).alias("term"))
    return rows.join(F.broadcast(datasets.categories(spark)), "term", "left").select("p_partkey", "term", "description")  # 25 rows


def packed_groups(spark: SparkSession, d: str) -> DataFrame:
    one = F.concat("p_type", F.lit("@2759|x,"), "p_brand", F.lit("@1|root"))
    two = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit(",more@2759|y,"), "p_type", F.lit("@33|z"))).otherwise(F.lit(""))
    return table(spark, d, "part").select(F.concat(F.lit("s"), (F.col("p_partkey") % 3).cast("string")).alias("species"), F.concat(F.lit("s"), (F.col("p_partkey") % 3).cast("string"), F.lit("_"), F.col("p_partkey").cast("string")).alias("gene"), F.concat(one, two).alias("groups"))


PACKED = """SELECT 's' || (p_partkey % 3) AS species, 's' || (p_partkey % 3) || '_' || p_partkey AS gene,
 p_type || '@2759|x,' || p_brand || '@1|root' || CASE WHEN p_partkey % 7 = 0 THEN ',more@2759|y,' || p_type || '@33|z' ELSE '' END AS groups FROM part"""
PARSED = """SELECT DISTINCT species, gene, split_part(g,'@',1) AS og FROM (
 SELECT *, count(*) OVER (PARTITION BY gene) AS n FROM (SELECT species, gene, unnest(string_split(groups, ',')) AS g FROM packed) WHERE split_part(split_part(g,'@',2),'|',1) = '{0}')
 WHERE n = 1 OR '{0}' <> '2759'"""


@query(with_tables("", "SELECT species, gene, og FROM a UNION ALL SELECT species, gene, 'root:' || og FROM b", packed=PACKED, a=PARSED.format(2759), b=PARSED.format(1)))
def orthology_groups_parse(spark: SparkSession, d: str) -> DataFrame:
    packed = packed_groups(spark, d)
    return paralogs.orthology_groups(packed, 2759).unionByName(paralogs.orthology_groups(packed, 1).withColumn("og", F.concat(F.lit("root:"), "og")))


@query(with_tables("", "SELECT DISTINCT least(x.gene, y.gene) AS a, greatest(x.gene, y.gene) AS b FROM p x JOIN p y USING (og) WHERE x.species <> y.species", packed=PACKED, p=PARSED.format(1)))
def orthology_pairs(spark: SparkSession, d: str) -> DataFrame:
    """At taxon 1, groups are the brands; a group's pairs are the result."""
    return paralogs.orthology_pairs(packed_groups(spark, d), 1)


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(0.5 + 0.5 * tanh(10 * (l_discount - 0.5)), 6) AS half, round(0.7 + 0.3 * tanh(10 * (l_tax * 10 - 0.7)), 6) AS high, round(greatest(l_discount - 0.05, 1e-3), 6) AS floored FROM lineitem")
def tanh_scale(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r(numeric.tanh_scale(F.col("l_discount"))).alias("half"), r(numeric.tanh_scale(F.col("l_tax") * 10, 10, 0.7)).alias("high"), r(numeric.floored(F.col("l_discount") - 0.05)).alias("floored"))


@query("SELECT p_size, round(lgamma(p_size + 1), 6) AS lf, count(*) AS n FROM part GROUP BY p_size")
def log_factorial(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "part").groupBy("p_size").agg(F.count(F.lit(1)).alias("n"))
    return sizes.select("p_size", r(numeric.ln_factorial(F.col("p_size"))).alias("lf"), "n")


@query(with_tables("hits", f"SELECT query, target, bitscore FROM hits WHERE evalue <= {EVALUE} AND query IS NOT NULL AND target IS NOT NULL"))
def hits_filtered(spark: SparkSession, d: str) -> DataFrame:
    return homology.usable_hits(domain.hits(spark, d), EVALUE)


GRAPH = """SELECT g1, g2, split_part(g1,'_',1) AS s1, split_part(g2,'_',1) AS s2, weight FROM (
 SELECT x.query AS g1, x.target AS g2, (x.b + y.b) / 2 AS weight FROM best x JOIN best y ON x.query = y.target AND x.target = y.query)"""
BEST = f"SELECT query, target, max(bitscore) AS b FROM hits WHERE evalue <= {EVALUE} GROUP BY ALL"


def graph(spark: SparkSession, d: str, reciprocal: bool = True) -> DataFrame:
    usable = domain.hits(spark, d).filter(F.col("evalue") <= EVALUE)
    return homology.graph(usable.filter("direction = 0"), usable.filter("direction = 1"), reciprocal)


@query(with_tables("hits", "SELECT g1, g2, s1, s2, round(weight, 6) AS weight FROM g", best=BEST, g=GRAPH))
def reciprocal_hits(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).withColumn("weight", r("weight"))


@query(with_tables("hits", "SELECT g1, g2, split_part(g1,'_',1) AS s1, split_part(g2,'_',1) AS s2, round(w, 6) AS weight FROM (SELECT g1, g2, sum(b) / 2 AS w FROM (SELECT query AS g1, target AS g2, b FROM best UNION ALL SELECT target, query, b FROM best) GROUP BY ALL)", best=BEST))
def one_way_hits(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d, False).withColumn("weight", r("weight"))


PRUNED = "SELECT g1, g2, s1, s2, weight FROM (SELECT *, max(weight) OVER (PARTITION BY g1) AS m1, max(weight) OVER (PARTITION BY g2) AS m2 FROM g) WHERE weight >= 0.9 * m1 OR weight >= 0.9 * m2"


@query(with_tables("hits", "SELECT g1, g2, s1, s2, round(weight, 6) AS weight FROM p", best=BEST, g=GRAPH, p=PRUNED))
def homology_pruned(spark: SparkSession, d: str) -> DataFrame:
    """A share of 0.9, as scores here are close together."""
    return homology.prune(graph(spark, d), 0.9).withColumn("weight", r("weight"))


@query(with_tables("hits", "SELECT g1, g2, s1, s2, round(w, 6) AS weight FROM (SELECT *, weight / max(weight) OVER (PARTITION BY g1) AS w FROM g) WHERE w <> 0 AND (s1 = 'pa' OR split_part(g1,'_',2)::INT % 3 > 0) AND (s2 = 'pa' OR split_part(g2,'_',2)::INT % 3 > 0)", best=BEST, g=GRAPH))
def homology_rowmax(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers weigh their number mod 3, parts 1."""
    edges = graph(spark, d)
    genes = edges.select(F.col("g1").alias("gene"), F.when(F.col("s1") == "pa", F.lit(1.0)).otherwise((F.split_part("g1", F.lit("_"), F.lit(2)).cast("int") % 3).cast("double")).alias("weight")).distinct()
    return homology.weighted(edges, genes).select("g1", "g2", "s1", "s2", r("weight").alias("weight"))


@query(with_tables("hits", "SELECT coalesce(a.symbol, g1) AS g1, coalesce(b.symbol, g2) AS g2, s1, s2, round(max(weight), 6) AS weight FROM g LEFT JOIN n a ON g1 = a.header LEFT JOIN n b ON g2 = b.header GROUP BY 1, 2, 3, 4", best=BEST, g=GRAPH, n="SELECT header, arg_min(symbol, ord) AS symbol FROM (SELECT 'pa_' || p_partkey || CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE '' END AS header, 'pa_' || p_brand AS symbol, p_partkey AS ord FROM part) GROUP BY header"))
def homology_coarsened(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth part has no name that the graph knows."""
    names = table(spark, d, "part").select(F.concat(F.lit("pa_"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 5 == 0, F.lit("x")).otherwise(F.lit(""))).alias("header"), F.concat(F.lit("pa_"), "p_brand").alias("symbol"), F.col("p_partkey").alias("ord"))
    return homology.coarsen(graph(spark, d), names).withColumn("weight", r("weight"))


@query(with_tables("hits", "SELECT g2 AS gene, round(weight, 6) AS weight FROM g WHERE g1 = 'su_7'", best=BEST, g=GRAPH))
def gene_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return homology.neighbours(graph(spark, d), "su_7").select("gene", r("weight").alias("weight"))


@query(with_tables("hits", "SELECT round(coalesce(max(weight), 0.0), 6) AS weight FROM g WHERE g1 = 'su_7' AND g2 = 'pa_6'", best=BEST, g=GRAPH))
def gene_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return homology.edge(graph(spark, d), "su_7", "pa_6").select(r("weight").alias("weight"))


@query(with_tables("expr", "SELECT species, cell, gene, value FROM expr"))
def expr_matrix(spark: SparkSession, d: str) -> DataFrame:
    return domain.expr(spark, d)


STATS = """SELECT species, gene, s / n AS mean, CASE WHEN q / n - (s / n) * (s / n) <= 0 THEN 1.0 ELSE sqrt(q / n - (s / n) * (s / n)) END AS sd FROM
 (SELECT species, gene, sum(value) AS s, sum(value * value) AS q FROM expr GROUP BY ALL) JOIN (SELECT species, count(*) AS n FROM cells GROUP BY ALL) USING (species)"""
SCALED = "SELECT e.species, cell, e.gene, value * (weight / sd) AS value FROM expr e JOIN stats s ON e.species = s.species AND e.gene = s.gene JOIN genes g ON g.gene = e.gene WHERE weight <> 0"


@query(with_tables("expr", "SELECT species, gene, round(mean, 6) AS mean, round(sd, 6) AS sd FROM stats", stats=STATS))
def expr_gene_stats(spark: SparkSession, d: str) -> DataFrame:
    return expression.gene_stats(domain.expr(spark, d), domain.customers(spark, d)).select("species", "gene", r("mean").alias("mean"), r("sd").alias("sd"))


@query(with_tables("expr genes", "SELECT species, cell, gene, round(value, 6) AS value FROM scaled", stats=STATS, scaled=SCALED))
def expr_scaled(spark: SparkSession, d: str) -> DataFrame:
    return expression.scaled(domain.expr(spark, d), domain.customers(spark, d), domain.genes(spark, d)).withColumn("value", r("value"))


@query(with_tables("expr", "SELECT e.species, cell, e.gene, round((value - mean) / sd, 6) AS value FROM expr e JOIN stats s USING (species, gene) WHERE value > mean", stats=STATS))
def expr_standardized(spark: SparkSession, d: str) -> DataFrame:
    e = domain.expr(spark, d)
    return expression.standardised(e, expression.gene_stats(e, domain.customers(spark, d))).withColumn("value", r("value"))


@query(with_tables("expr", "SELECT species, e.cell, gene, round((value - s / 100) / sqrt(q / 100 - (s / 100) * (s / 100)), 6) AS value FROM expr e JOIN (SELECT cell, sum(value) AS s, sum(value * value) AS q FROM expr GROUP BY cell) t ON e.cell = t.cell WHERE value > s / 100"))
def expr_standardized_rows(spark: SparkSession, d: str) -> DataFrame:
    return expression.standardised_rows(domain.expr(spark, d), domain.genes(spark, d)).withColumn("value", r("value"))


@query(with_tables("expr", "SELECT species, cell, gene, round(value, 6) AS value FROM s WHERE (species, gene) IN (SELECT (species, gene) FROM f JOIN n USING (species) WHERE k / n <= 0.96)",
    n="SELECT species, count(*) AS n FROM cells GROUP BY ALL", t="SELECT species, cell, sum(value) AS total FROM expr GROUP BY ALL", m="SELECT species, quantile_cont(total, 0.5) AS med FROM t GROUP BY ALL",
    s="SELECT e.species, e.cell, gene, ln(1 + value * med / total) / ln(2) AS value FROM expr e JOIN t USING (cell) JOIN m ON m.species = e.species", f="SELECT species, gene, count(*) AS k FROM s WHERE value >= 1 GROUP BY ALL"))
def expr_preprocessed(spark: SparkSession, d: str) -> DataFrame:
    return expression.preprocess(domain.expr(spark, d), domain.customers(spark, d)).withColumn("value", r("value"))


TRANSLATED = "SELECT e.species, cell, g2 AS gene, sum(value * weight) AS value FROM scaled e JOIN homology ON gene = g1 WHERE s1 <> s2 GROUP BY ALL"


@query(with_tables("expr genes homology", "SELECT species, cell, gene, round(value, 6) AS value FROM t", stats=STATS, scaled=SCALED, t=TRANSLATED))
def translate_features(spark: SparkSession, d: str) -> DataFrame:
    scaled = expression.scaled(domain.expr(spark, d), domain.customers(spark, d), domain.genes(spark, d))
    return expression.translate(scaled, domain.shared_homology(spark, d)).withColumn("value", r("value"))


@query(with_tables("expr genes loadings", """SELECT c.species, c.cell, m.pc, round(coalesce(v, 0) - mean, 6) AS value FROM cells c JOIN (SELECT species, pc, sum(v) / n AS mean FROM p JOIN (SELECT species, count(*) AS n FROM cells GROUP BY ALL) USING (species) GROUP BY species, pc, n) m USING (species)
 LEFT JOIN p ON p.cell = c.cell AND p.pc = m.pc""", stats=STATS, scaled=SCALED, p="SELECT s.species, cell, pc, sum(s.value * l.value) AS v FROM scaled s JOIN loadings l USING (gene) GROUP BY ALL"))  # fmt: skip
def project_features(spark: SparkSession, d: str) -> DataFrame:
    cells = domain.customers(spark, d)
    scaled = expression.scaled(domain.expr(spark, d), cells, domain.genes(spark, d))
    return expression.centred(expression.project(scaled, domain.loadings(spark, d)), cells).withColumn("value", r("value"))


MATRIX = "SELECT c_nationkey AS i, p_size AS j, sum(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY ALL"


def matrix(spark: SparkSession, d: str) -> DataFrame:
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(F.col("c_nationkey").alias("i"), F.col("p_size").alias("j")).agg(F.sum("l_quantity").alias("v"))


@query(with_tables("", "SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM m a JOIN m b ON a.j = b.j GROUP BY ALL", m=MATRIX))
def sparse_matmul(spark: SparkSession, d: str) -> DataFrame:
    m = matrix(spark, d)
    return linalg.matmul(m, linalg.transpose(m))


@query(with_tables("", "SELECT i, j, sum(v) AS v FROM (SELECT i, j, v * v AS v FROM m UNION ALL SELECT j, i, v FROM m) GROUP BY ALL", m=MATRIX))
def sparse_hadamard_add(spark: SparkSession, d: str) -> DataFrame:
    m = matrix(spark, d)
    return linalg.add(linalg.hadamard(m, m), linalg.transpose(m))


@query(with_tables("", "SELECT i, j, round(v / max(v) OVER (PARTITION BY i), 6) AS by_max, round(v / sum(v) OVER (PARTITION BY i), 6) AS by_row, round(v / sum(v) OVER (PARTITION BY j), 6) AS by_column FROM m", m=MATRIX))
def row_normalize(spark: SparkSession, d: str) -> DataFrame:
    m = matrix(spark, d).withColumns({"by_max": F.col("v"), "by_row": F.col("v"), "by_column": F.col("v")})
    m = linalg.by_row_sum(linalg.by_row_sum(linalg.by_row_max(m, "i", value="by_max"), "i", value="by_row"), "j", value="by_column")
    return m.select("i", "j", *[r(c).alias(c) for c in ("by_max", "by_row", "by_column")])


@query(with_tables("hits", "SELECT g1, g2, s1, s2, round(weight, 6) AS weight FROM g", best=BEST, g=GRAPH))
def hits_from_files(spark: SparkSession, d: str) -> DataFrame:
    """The graph of reciprocal hits, by way of tab-separated files without prefixes, read by pair of datasets."""
    rows = domain.hits(spark, d)
    bare = lambda c: F.split_part(c, F.lit("_"), F.lit(2))
    columns = [bare("query").alias("query"), bare("target").alias("target"), F.lit(99.0).alias("pident"), *[F.lit(1).alias(c) for c in "abcdefg"], "evalue", "bitscore"]
    folder = f"{checkpoint.folder(spark)}/maps"
    for direction, name in ((0, "pa_to_su"), (1, "su_to_pa")):
        rows.filter(F.col("direction") == direction).select(*columns).write.option("sep", "\t").csv(f"{folder}/supa/{name}.txt")
    return hits.read_homology(spark, folder, ["pa", "su"], EVALUE).withColumn("weight", r("weight"))


@query("SELECT r_regionkey, r_name, n_nationkey, n_name FROM region JOIN nation ON r_regionkey = n_regionkey")
def session_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Tables written as a session and read back by its manifest."""
    folder = f"{checkpoint.folder(spark)}/session"
    store.save(spark, {"region": table(spark, d, "region"), "nation": table(spark, d, "nation")}, folder)
    back = store.load(spark, folder)
    return back["region"].join(back["nation"], F.col("r_regionkey") == F.col("n_regionkey")).select("r_regionkey", "r_name", "n_nationkey", "n_name")


@query(with_tables("hits", "SELECT g1, g2, s1, s2, round(weight, 6) AS weight FROM g WHERE g1 IN (SELECT gene FROM k) AND g2 IN (SELECT gene FROM k)", best=BEST, g=GRAPH, k="SELECT 'pa_' || p_partkey AS gene FROM part WHERE p_size > 45 UNION SELECT 'su_' || s_suppkey FROM supplier WHERE s_acctbal > 0"))
def genes_present(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").filter("p_size > 45").select(F.concat(F.lit("pa_"), F.col("p_partkey").cast("string")).alias("gene"))
    suppliers = table(spark, d, "supplier").filter("s_acctbal > 0").select(F.concat(F.lit("su_"), F.col("s_suppkey").cast("string")).alias("gene"))
    return homology.present(graph(spark, d), parts.union(suppliers)).withColumn("weight", r("weight"))


@query("SELECT DISTINCT a, b FROM (SELECT l_partkey AS a, l_suppkey AS b FROM lineitem UNION ALL SELECT l_suppkey, l_partkey FROM lineitem)")
def symmetric_closure(spark: SparkSession, d: str) -> DataFrame:
    return pairs.both_ways(table(spark, d, "lineitem"), "l_partkey", "l_suppkey")


@query(with_tables("hits", "SELECT query, target, max(bitscore) AS bitscore FROM hits WHERE evalue <= 0.05 AND target NOT IN ('NA', 'null', 'su_7') GROUP BY ALL"))
def hits_best(spark: SparkSession, d: str) -> DataFrame:
    """Names that look like missing values are dropped on request; here su_7 is called NA."""
    rows = domain.hits(spark, d).withColumn("target", F.when(F.col("target") == "su_7", F.lit("NA")).otherwise(F.col("target")))
    return homology.best_hits(homology.usable_hits(rows, EVALUE, drop_missing_tokens=True))


@query(with_tables("genes", "SELECT species, pc::INT AS pc, count(*) AS n_genes, 1.0::DOUBLE AS length, 0.0::DOUBLE AS residual FROM genes, range(3) t(pc) WHERE weight > 0 GROUP BY ALL"))
def pca_loadings(spark: SparkSession, d: str) -> DataFrame:
    """Principal axes v of each segment's scaled features, whose signs are free: their length, and |C v - λ v| over λ (with C their covariance), to three digits."""
    cells = domain.customers(spark, d)
    axes = checkpoint.cut(expression.components(domain.expr(spark, d), cells, domain.genes(spark, d), 3))
    scaled = checkpoint.cut(expression.scaled(domain.expr(spark, d), cells, domain.genes(spark, d)))
    moved = expression.centred(expression.project(scaled, axes.select("gene", "pc", "value")), cells).select("cell", "pc", F.col("value").alias("p"))
    product = scaled.join(moved, "cell").groupBy("gene", "pc").agg(F.sum(F.col("value") * F.col("p")).alias("cv"))
    both = axes.join(product, ["gene", "pc"], "left").na.fill(0.0, ["cv"])
    value = both.groupBy("species", "pc").agg(F.sqrt(F.sum(F.col("cv") * F.col("cv"))).alias("l"), F.count(F.lit(1)).alias("n_genes"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("length"))
    off = both.join(value, ["species", "pc"]).groupBy("species", "pc", "n_genes", "length", "l").agg(F.sqrt(F.sum((F.col("cv") - F.col("l") * F.col("value")) ** 2)).alias("off"))
    return off.select("species", "pc", "n_genes", r("length").alias("length"), (r(F.col("off") / F.col("l"), 3) + 0.0).alias("residual"))
