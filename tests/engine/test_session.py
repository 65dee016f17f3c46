"""The mapping loop against dense NumPy, and what hangs on it."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossweave import exceptions
from crossweave.operators import gene_pairs, homology, knn, markers, paralogs, refine, stitch, triangles
from crossweave.plans.session import Mapping
from crossweave.sources import hits, store
from crossweave.sources.schema import checked
from crossweave.streaming.hits import stream_hits

N, G, K, HOPS = 24, 12, 4, 2
SPECIES = ["hu", "ms"]


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(42)
    names = {s: [f"{s}_c{i:02d}" for i in range(N)] for s in SPECIES}
    genes = {s: [f"{s}_g{j:02d}" for j in range(G)] for s in SPECIES}
    profile = rng.gamma(2.0, 1.0, (3, G))
    x = {s: rng.poisson(profile[np.arange(N) % 3] * 2) * (rng.random((N, G)) < 0.8) * 1.0 for s in SPECIES}
    w = {s: np.round(rng.random(G), 3) for s in SPECIES}
    w["hu"][3] = 0.0
    pcs = {s: np.round(rng.normal(size=(G, 3)), 3) for s in SPECIES}
    graphs = {s: np.round(rng.random((N, N)) * (rng.random((N, N)) < 0.15), 3) * (1 - np.eye(N)) for s in SPECIES}
    h = np.round(rng.random((G, G)) * 0.5 + 0.5, 3) * ((np.eye(G) + (rng.random((G, G)) < 0.15)) > 0)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "x": x, "w": w, "pcs": pcs, "graphs": graphs, "h": h, "names": names, "gene_names": genes,
        "expr": frame([(s, names[s][i], genes[s][j], float(x[s][i, j])) for s in SPECIES for i, j in zip(*np.nonzero(x[s]))], "species string, cell string, gene string, value double"),
        "cells": frame([(s, names[s][i], str(i % 3)) for s in SPECIES for i in range(N)], "species string, cell string, cluster string"),
        "genes": frame([(s, genes[s][j], float(w[s][j])) for s in SPECIES for j in range(G)], "species string, gene string, weight double"),
        "loadings": frame([(s, genes[s][j], p, float(pcs[s][j, p])) for s in SPECIES for j in range(G) for p in range(3)], "species string, gene string, pc int, value double"),
        "graph": frame([(names[s][i], names[s][j], float(graphs[s][i, j])) for s in SPECIES for i, j in zip(*np.nonzero(graphs[s]))], "src string, dst string, weight double"),
        "homology": homology.symmetric(frame([(genes["hu"][i], genes["ms"][j], float(h[i, j])) for i, j in zip(*np.nonzero(h))], "g1 string, g2 string, weight double")),
    }


def dense_pass(world, edges):
    """One pass in NumPy for two datasets; ``edges``: weights from (s, t), a pair of matrices."""
    scaled = {s: world["x"][s] / np.where(world["x"][s].std(0) == 0, 1, world["x"][s].std(0)) * world["w"][s] for s in SPECIES}
    latent = []
    for s, t in (("hu", "ms"), ("ms", "hu")):
        g = edges[s] / np.where(edges[s].max(1) == 0, 1, edges[s].max(1))[:, None]
        g = g * (world["w"][s] > 0)[:, None] * (world["w"][t] > 0)[None, :]
        g = np.where(g != 0, 0.5 + 0.5 * np.tanh(10 * (g - 0.5)), 0)
        moved = scaled[s] @ g
        sd = moved.std(0)
        moved = moved / np.where(sd == 0, 1, sd) * world["w"][t]
        block = {s: scaled[s] @ world["pcs"][s], t: moved @ world["pcs"][t]}
        v = np.hstack([block[q] for q in SPECIES])
        latent.append(v - v.mean(0))
    z = np.vstack(latent)
    u = z / np.linalg.norm(z, axis=1, keepdims=True)
    cos = u @ u.T
    b = np.zeros((2 * N, 2 * N))
    for i in range(2 * N):
        other = range(N, 2 * N) if i < N else range(N)
        near = sorted(other, key=lambda j: -cos[i, j])[:K]
        sim = np.maximum(cos[i, near], 1e-3)
        sim = 0.7 + 0.3 * np.tanh(10 * (sim / sim.max() - 0.7))
        b[i, near] = sim / sim.sum()
    hood = np.zeros((2 * N, 2 * N))
    for k, s in enumerate(SPECIES):
        g = world["graphs"][s]
        rings, walk, seen = [g], g, g != 0
        for _ in range(HOPS):
            walk = walk @ g
            rings.append(np.where(seen, 0, walk))
            seen = seen | (walk != 0)
        for i in range(N):
            order = sorted(((r, -m[i, j], j) for r, m in enumerate(rings) for j in np.flatnonzero(m[i])))[: N // 3]
            hood[k * N + i, [k * N + j for _, _, j in order]] = 1
    c = b @ hood.T
    c[c < 0.1 - 1e-12] = 0
    d = np.sqrt(c * c.T)
    r = np.where(d > 0, np.maximum(np.corrcoef(z), 1e-3), 0)
    f = np.where(d > 0, 0.7 + 0.3 * np.tanh(10 * (r / np.maximum(r.max(1, keepdims=True), 1e-300) - 0.7)), 0)
    e = np.sqrt(f * d)
    d = e * d.max(1, keepdims=True) / np.where(e.max(1, keepdims=True) == 0, 1, e.max(1, keepdims=True))
    dk = np.zeros_like(d)
    for i in range(2 * N):
        for j in sorted(np.flatnonzero(d[i]), key=lambda j: (-d[i, j], j))[:K]:
            dk[i, j] = d[i, j]
    inner = np.zeros_like(d)
    for k, s in enumerate(SPECIES):
        inner[k * N : (k + 1) * N, k * N : (k + 1) * N] = world["graphs"][s] != 0
    return z, b, dk, (1 - dk.sum(1, keepdims=True) / K) * inner + dk


def dense_refine(world, nnm):
    means = {}
    for k, s in enumerate(SPECIES):
        part = nnm[:, k * N : (k + 1) * N]
        total = part.sum(1, keepdims=True)
        means[s] = part @ world["x"][s] / np.where(total < 1e-3, 1, total)
    out = np.zeros((G, G))
    for i, j in zip(*np.nonzero(world["h"])):
        a, b = means["hu"][:, i], means["ms"][:, j]
        out[i, j] = np.corrcoef(a, b)[0, 1] if a.std() > 1e-9 and b.std() > 1e-9 else 0
    return np.where(out < 0, 0, np.nan_to_num(out))


def as_matrix(df, names):
    at = {n: i for i, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for r in df.collect():
        m[at[r["src"]], at[r["dst"]]] = r["weight"]
    return m


@pytest.fixture(scope="module")
def mapped(world):
    m = Mapping(world["expr"], world["cells"], world["genes"], world["graph"], world["loadings"], edges=world["homology"], prune_share=0.0)
    return m.run(iterations=2, hops=HOPS, k=K)


def test_loop_against_numpy(world, mapped):
    order = [n for s in SPECIES for n in world["names"][s]]
    _, _, _, nnm = dense_pass(world, {"hu": world["h"], "ms": world["h"].T})
    corr = dense_refine(world, nnm)
    # Features without weight take no part in the refinement.
    corr *= (world["w"]["hu"] > 0)[:, None] * (world["w"]["ms"] > 0)[None, :]
    got = np.zeros((G, G))
    for r in mapped.refined.filter("s1 = 'hu'").collect():
        got[world["gene_names"]["hu"].index(r["g1"]), world["gene_names"]["ms"].index(r["g2"])] = r["weight"]
    assert np.allclose(got, corr, atol=1e-9)
    z, b, dk, nnm = dense_pass(world, {"hu": corr, "ms": corr.T})
    latent = {r["cell"]: r["vec"] for r in mapped.latent.collect()}
    assert np.allclose(np.array([latent[c] for c in order]), z, atol=1e-9)
    assert np.allclose(as_matrix(mapped.knn, order), b, atol=1e-9)
    assert np.allclose(as_matrix(mapped.edges, order), dk, atol=1e-9)
    assert np.allclose(as_matrix(mapped.graph, order), nnm, atol=1e-9)


def test_given_neighbours(world, mapped):
    m = Mapping(world["expr"], world["cells"], world["genes"], world["graph"], world["loadings"], edges=world["homology"], prune_share=0.0)
    m.run(iterations=1, hops=HOPS, k=K, near=mapped.knn, latent=mapped.latent)
    got, want = ({(r["src"], r["dst"]): r["weight"] for r in x.edges.collect()} for x in (m, mapped))
    assert got.keys() == want.keys() and all(math.isclose(got[e], want[e], abs_tol=1e-9) for e in want)
    with pytest.raises(ValueError):
        m.run(near=mapped.knn)


def test_invariants(mapped):
    sums = mapped.knn.groupBy("src", "dst_species").agg(F.sum("weight").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    assert all(math.isclose(r["s"], 1.0) and r["n"] == K for r in sums)
    assert mapped.edges.filter("weight < 0 OR weight > 1.0000001").count() == 0
    one = mapped.refined.select("g1", "g2", "weight")
    assert one.exceptAll(one.select(F.col("g2"), F.col("g1"), "weight")).count() == 0


def test_queries_of_a_mapping(mapped, world, tmp_path, spark):
    found = mapped.query_gene("g05")
    assert {r["gene"] for r in found["sequence"].collect()} == {world["gene_names"]["ms"][j] for j in np.flatnonzero(world["h"][5])}
    pair = mapped.query_gene_pair("hu_g05", "ms_g05")
    assert pair["sequence"].first()["weight"] == world["h"][5, 5]
    assert mapped.query_gene_pair("hu_g05", "hu_g06")["correlation"].first()["weight"] == 0.0
    with pytest.raises(exceptions.GeneNotFoundError):
        mapped.query_gene("nothing")
    s = mapped.mapping_scores().collect()
    assert len(s) == 36 and all(0 <= r["score"] <= 1 for r in s)
    assert {(r["c1"], r["c2"], round(r["score"], 9)) for r in s} == {(r["c2"], r["c1"], round(r["score"], 9)) for r in s}
    assert {r["s1"] + r["s2"] for r in mapped.alignment().filter("weight > 0").collect()} == {"hums", "mshu"}
    finder = mapped.pair_finder()
    some = finder.find_all(align_thr=0.0, thr=1.1)
    assert some.count() > 0 and some.filter("p1 > 1 OR p2 > 1").count() == 0
    one = finder.find_genes("ms_1", "hu_1", thr=1.1)
    assert {(r["c1"], r["c2"]) for r in one.collect()} <= {("hu_1", "ms_1")}
    folder = str(tmp_path / "session")
    mapped.save(folder)
    again = Mapping.load(spark, folder)
    assert again.graph.exceptAll(mapped.graph).count() == 0 and again.k == mapped.k == K and len(again.history) == len(mapped.history) == 1
    before, after = ({(r["c1"], r["c2"]): r["score"] for r in x.mapping_scores().collect()} for x in (mapped, again))
    assert before.keys() == after.keys() and all(math.isclose(before[c], after[c], abs_tol=1e-12) for c in before)
    assert again.alignment().exceptAll(mapped.alignment()).filter("weight > 1").count() == 0
    assert set(store.load(spark, folder)) >= {"expr", "cells", "refined"}


def test_before_a_run(world):
    m = Mapping(world["expr"], world["cells"], world["genes"], world["graph"], world["loadings"], edges=world["homology"])
    for ask in (m.alignment, m.mapping_scores, lambda: m.query_gene("hu_g01"), m.refine):
        with pytest.raises(exceptions.MappingError):
            ask()
    with pytest.raises(ValueError):
        m.run(k=0)
    with pytest.raises(exceptions.SpeciesNotFoundError):
        m.run(cocluster={"zz"})
    with pytest.raises(TypeError):
        checked("no table", "expr")
    with pytest.raises(exceptions.DataError, match="value"):
        checked(world["expr"].drop("value"), "expr")


def test_other_branches(world):
    bare = lambda df: df.withColumn("gene", F.split_part("gene", F.lit("_"), F.lit(2)))
    m = Mapping(bare(world["expr"]), world["cells"], bare(world["genes"].filter("species = 'hu'")), world["graph"], bare(world["loadings"]))
    m.run(iterations=2, hops=1, k=K)
    assert m.refined is None and m.edges.count() > 0
    c = Mapping(world["expr"], world["cells"], world["genes"], world["graph"], edges=world["homology"], components=3)
    c.run(iterations=1, hops=1, k=K, cocluster={"ms"}, scale_edges_by_corr=False)
    assert c.edges.count() > 0
    assert c.refine(mode="xi").filter("weight < -1 OR weight > 1").count() == 0
    with pytest.raises(ValueError):
        c.refine(mode="spearman")


def test_markers_against_plain_ranks(spark, world):
    from crossweave.operators.markers import marker_scores

    got = {(r["gene"], r["cluster"]): r for r in markers.markers(world["expr"], world["cells"].withColumn("cluster", F.concat("species", F.lit("_"), "cluster")), world["genes"]).collect()}
    assert len(got) == 2 * G * 3
    for s in SPECIES:
        for j in range(G):
            v = world["x"][s][:, j]
            ranks = np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
            for c in range(3):
                of = np.arange(N) % 3 == c
                m = of.sum()
                z = (ranks[of].sum() - m * (N + 1) / 2) / math.sqrt(m * (N - m) * (N + 1) / 12)
                r = got[f"{s}_g{j:02d}", f"{s}_{c}"]
                assert math.isclose(r["score"], max(z, 0), abs_tol=1e-9)
                assert math.isclose(r["pval"], 1.0 if z < 0 else math.erfc(abs(z) / math.sqrt(2)), abs_tol=1e-9)
    alone = world["cells"].withColumn("cluster", F.when(F.col("cell") == "hu_c00", F.lit("one")).otherwise(F.col("cluster")))
    assert {(r["score"], r["pval"]) for r in markers.markers(world["expr"], alone, world["genes"]).filter("cluster = 'one'").collect()} == {(0.0, 1.0)}
    assert marker_scores(world["expr"], alone, world["genes"]).filter("cluster = 'one'").count() == 0


def test_xi_against_plain(spark):
    rng = np.random.default_rng(3)
    rows = [(k, i, float(rng.integers(0, 9)), float(rng.integers(0, 6))) for k in range(3) for i in range(40)] + [(9, i, float(i), 1.0) for i in range(5)]
    got = {r["k"]: r["xi"] for r in refine.xi(spark.createDataFrame(rows, "k int, i int, x double, y double"), ["k"], "x", "y", ["i"]).collect()}
    for k in (0, 1, 2):
        own = sorted((x, i, y) for kk, i, x, y in rows if kk == k)
        y = np.array([v for _, _, v in own])
        r, l, n = np.array([(y <= v).sum() for v in y]), np.array([(y >= v).sum() for v in y]), len(y)
        assert math.isclose(got[k], 1 - n * np.abs(np.diff(r)).sum() / (2 * (l * (n - l)).sum()))
    assert got[9] == 0.0


def test_tiles_give_the_same_neighbours(spark):
    rng = np.random.default_rng(5)
    latent = spark.createDataFrame([(i, f"s{i % 3}", rng.normal(size=6).tolist()) for i in range(90)], "cell long, species string, vec array<double>")
    whole, tiled = (sorted((r["src"], r["dst"], round(r["cos"], 9)) for r in knn.nearest(latent, 5, tile=t).collect()) for t in (4096, 20))
    assert whole == tiled and len(whole) == 90 * 2 * 5
    exact = {(s, d) for s, d, _ in whole}
    near = {(r["src"], r["dst"]) for r in knn.approximate(latent, 5, tile=7).collect()}
    assert len(exact & near) > 0.9 * len(exact) and len(near) <= len(exact)
    assert {(r["src"], r["dst"]) for r in knn.approximate(latent, 5, recall=1.0, most=1).collect()} == exact
    assert knn.approximate(latent.limit(0), 5).count() == 0


def test_recall_of_the_approximate_search(spark):
    """At its defaults, on real vectors."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("cell"), F.concat(F.lit("s"), (F.col("vec_id") % 2).cast("string")).alias("species"), F.col("embedding").cast("array<double>").alias("vec"))
    exact, near = ({(r["src"], r["dst"]) for r in search(rows, 20).collect()} for search in (knn.nearest, knn.approximate))
    assert len(exact & near) >= 0.9 * len(exact)


def test_hit_files(spark, tmp_path):
    folder = tmp_path / "maps"
    (folder / "hums").mkdir(parents=True)
    line = lambda q, t, e, b: "\t".join([q, t, "99.0", "10", "0", "0", "1", "10", "1", "10", str(e), str(b)])
    (folder / "hums" / "hu_to_ms.txt").write_text("\n".join([line("A", "x", 1e-6, 10), line("A", "x", 1e-9, 30), line("hu_B", "y", 1e-5, 99), line("NA", "z", 1e-9, 8), line("C", "w", 1e-9, 5)]))
    (folder / "hums" / "ms_to_hu.txt").write_text("\n".join([line("x", "A", 1e-8, 20), line("ms_z", "NA", 1e-9, 4)]))
    got = {(r["g1"], r["g2"]): r["weight"] for r in hits.read_homology(spark, str(folder), ["ms", "hu"]).collect()}
    assert got == {("hu_A", "ms_x"): 25.0, ("ms_x", "hu_A"): 25.0, ("hu_NA", "ms_z"): 6.0, ("ms_z", "hu_NA"): 6.0}
    assert ("hu_NA", "ms_z") not in {(r["g1"], r["g2"]) for r in hits.read_homology(spark, str(folder), ["ms", "hu"], drop_missing_tokens=True).collect()}
    one_way = {(r["g1"], r["g2"]): r["weight"] for r in hits.read_homology(spark, str(folder), ["hu", "ms"], reciprocal=False).collect()}
    assert one_way["hu_C", "ms_w"] == 2.5
    with pytest.raises(FileNotFoundError):
        hits.read_homology(spark, str(folder), ["hu", "zz"])


def test_hits_as_a_stream(spark, tmp_path):
    folder = tmp_path / "arriving"
    folder.mkdir()
    (folder / "a.txt").write_text("A\tx\t99\t1\t0\t0\t1\t1\t1\t1\t1e-9\t10\nA\tx\t99\t1\t0\t0\t1\t1\t1\t1\t1e-9\t40\nB\ty\t9\t1\t0\t0\t1\t1\t1\t1\t0.5\t7")
    stream = stream_hits(spark, str(folder)).writeStream.outputMode("complete").format("memory").queryName("hits_so_far").start()
    stream.processAllAvailable()
    (folder / "b.txt").write_text("A\tx\t99\t1\t0\t0\t1\t1\t1\t1\t1e-9\t50")
    stream.processAllAvailable()
    stream.stop()
    assert [tuple(r) for r in spark.table("hits_so_far").collect()] == [("A", "x", 50.0)]


def test_prune_and_symmetry(spark):
    edges = homology.symmetric(spark.createDataFrame([("a_1", "b_1", 100.0), ("a_1", "b_2", 20.0), ("a_2", "b_2", 90.0), ("a_1", "c_1", 24.9), ("a_3", "c_1", 25.0)], "g1 string, g2 string, weight double"))
    kept = {(r["g1"], r["g2"]) for r in homology.prune(edges).collect()}
    assert ("a_1", "b_2") not in kept and ("a_1", "c_1") in kept and ("c_1", "a_1") in kept
    assert ("a_1", "b_2") not in {(r["g1"], r["g2"]) for r in homology.prune(edges, per_species=True).collect()}


def test_triangles_and_thresholds(spark):
    scores = [("a_1", "b_1", 0.5), ("b_1", "c_1", 0.4), ("a_1", "c_1", 0.3), ("a_2", "b_2", 0.9), ("b_2", "c_2", 0.9), ("a_2", "c_2", 0.1), ("a_1", "a_2", 0.9)]
    cells = spark.createDataFrame([(c[0], f"x{i}", c) for i, c in enumerate(["a_1", "a_2", "b_1", "b_2", "c_1", "c_2"])], "species string, cell string, cluster string")
    found = triangles.cluster_triangles(spark.createDataFrame(scores, "c1 string, c2 string, score double"), cells, 0.1).collect()
    assert [(r["a"], r["b"], r["c"]) for r in found] == [("a_1", "b_1", "c_1")]
    types = triangles.cell_types(spark.createDataFrame([("g", "k1", 5.0, 1e-12), ("g", "k2", 4.0, 1e-11), ("g", "k3", 0.0, 1.0)], "gene string, cluster string, score double, pval double"))
    assert types.first()["types"] == "k1;k2"


def test_no_linked_cells(spark, world):
    empty = spark.createDataFrame([], "src string, dst string, weight double")
    clusters = spark.createDataFrame([("0", "1", "hu", "ms")], "c1 string, c2 string, s1 string, s2 string")
    assert gene_pairs.pair_scores(clusters, world["homology"], empty, world["expr"], world["cells"], world["genes"]).count() == 0


def test_stitching_keeps_unlinked_cells(spark):
    cells = spark.createDataFrame([("a", "1", "x"), ("b", "2", "y"), ("a", "3", "x")], "species string, cell string, cluster string")
    graph = spark.createDataFrame([("1", "3", 0.5)], "src string, dst string, weight double")
    across = spark.createDataFrame([], "src string, dst string, weight double")
    assert [tuple(r) for r in stitch.stitched(across, graph, cells, 5).collect()] == [("1", "3", 1.0)]


def test_entry_points_of_a_mapping(mapped, world, spark):
    orthologs = spark.createDataFrame([(f"hu_g{i:02d}", f"ms_g{i:02d}") for i in range(G)], "a string, b string")
    rows = mapped.substitutions(orthologs, threshold=-2.0).collect()
    assert rows and [r["corr_diff"] for r in rows] == sorted((r["corr_diff"] for r in rows), reverse=True)
    assert mapped.cluster_triangles(0.0).count() == 0 and mapped.gene_triangles(orthologs).count() == 0  # two datasets
    finder = mapped.pair_finder()
    assert finder.find_all(align_thr=0.0, thr=1.1, n_top=2).count() > 0
    strict, lax = (finder.find_all(align_thr=0.3, thr=1.1, n_top=n).select("c1", "c2").distinct().count() for n in (0, 1))
    assert strict <= lax  # the best cell alone maps a cluster better than all of them
    notes = spark.createDataFrame([(s, f"g{j:02d}", "AB"[j % 2] + "C") for s in SPECIES for j in range(G) if j % 5], "species string, gene string, packed string")
    made = mapped.enrichment(notes, align_thr=0.0, thr=1.1)
    assert {r["term"] for r in made.calculate().select("term").distinct().collect()} == {"A", "B", "C"}
    shown = made.plot_data(least=0.0).collect()
    assert len(shown) == len({r["node"] for r in shown}) * 3 and {r["term_at"] for r in shown} == {0, 1, 2}
    assert made.plot_data(nodes=["hu_0"], least=99.0).filter("enrichment <> 0 OR genes <> ''").count() == 0


def test_names_without_prefixes(world, mapped):
    bare = lambda df: df.withColumn("gene", F.split_part("gene", F.lit("_"), F.lit(2)))
    m = Mapping(bare(world["expr"]), world["cells"], bare(world["genes"]), world["graph"], bare(world["loadings"]), edges=world["homology"], prune_share=0.0)
    assert m.homology.count() == mapped.homology.count() > 0
    m.run(iterations=1, hops=1, k=K, search="approximate")
    assert m.edges.count() > 0
    with pytest.raises(ValueError):
        m.run(search="quick")


def test_annotations_of_all_features(spark):
    from crossweave.operators.enrichment import annotated

    genes = spark.createDataFrame([("hu", "hu_a"), ("hu", "hu_b"), ("ms", "ms_a")], "species string, gene string")
    notes = spark.createDataFrame([("hu", "a", "XY"), ("ms", "ms_z", "Q"), ("hu", "hu_b", None)], "species string, gene string, packed string")
    assert {tuple(r) for r in annotated(genes, notes).collect()} == {("hu", "hu_a", "XY"), ("hu", "hu_b", ""), ("ms", "ms_a", "")}


def test_ward_order():
    from crossweave.operators.enrichment import ward_order

    x = np.array([[0.0], [10.0], [0.1], [10.3], [5.0]])
    order = ward_order(x)
    assert sorted(order) == list(range(5)) and abs(order.index(0) - order.index(2)) == 1 and abs(order.index(1) - order.index(3)) == 1
    assert ward_order(np.zeros((0, 3))) == [] and ward_order(np.ones((1, 3))) == [0]
    rng = np.random.default_rng(1)
    y = rng.normal(size=(12, 4))
    # Brute force: merge what adds least to the squared deviations, the older cluster first.
    groups = [(i, [i]) for i in range(12)]
    cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((y[a].mean(0) - y[b].mean(0)) ** 2).sum()
    made = 12
    while len(groups) > 1:
        a, b = min(((a, b) for i, a in enumerate(groups) for b in groups[i + 1 :]), key=lambda p: cost(p[0][1], p[1][1]))
        a, b = sorted((a, b), key=lambda g: g[0])
        groups = [g for g in groups if g not in (a, b)] + [(made, a[1] + b[1])]
        made += 1
    assert ward_order(y) == groups[0][1]


def test_matrix_files(spark, tmp_path):
    from crossweave.sources.matrix import read_matrix

    (tmp_path / "features.tsv").write_text("A\tgene a\nhu_B\nC\n")
    (tmp_path / "barcodes.tsv").write_text("c1\nc2\n")
    (tmp_path / "matrix.mtx").write_text("%%MatrixMarket matrix coordinate real general\n% made by hand\n3 2 4\n1 1 2.5\n2 2 1\n2 2 3\n3 1 0\n")
    got = read_matrix(spark, str(tmp_path), "hu")
    assert {tuple(r) for r in got["expr"].collect()} == {("hu", "c1", "hu_A", 2.5), ("hu", "c2", "hu_B", 4.0)}
    assert {r["cell"] for r in got["cells"].collect()} == {"c1", "c2"} and {r["gene"] for r in got["genes"].collect()} == {"hu_A", "hu_B", "hu_C"}
    (tmp_path / "barcodes.tsv").write_text("c1\n")
    with pytest.raises(exceptions.DataError):
        read_matrix(spark, str(tmp_path), "hu")


def test_triangles_against_brute_force(spark):
    rng = np.random.default_rng(8)
    pairs = {tuple(sorted(p)) for p in rng.integers(0, 14, (60, 2)).tolist() if p[0] != p[1]} | {(0, k) for k in range(1, 14)}
    edges = {(f"n{a:02d}", f"n{b:02d}"): round(float(rng.random()), 6) for a, b in pairs}
    got = {tuple(r) for r in triangles.triangles(spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "a string, b string, w double")).collect()}
    names = sorted({x for e in edges for x in e})
    want = {(a, b, c, edges[a, b], edges[a, c], edges[b, c]) for a in names for b in names for c in names if (a, b) in edges and (b, c) in edges and (a, c) in edges}
    assert got == want and len(want) > 10


def test_orthology_pairs_of_one_large_group_are_spread(spark):
    """A group's pairs are made by several tasks, each pair once, also with several groups in common and names in several datasets."""
    rows = [(f"s{i % 3}", f"s{i % 3}_{i}", f"A{i % 2}@1|root,B@1|root" + (",C@1|root" if i % 5 == 0 else "")) for i in range(120)] + [("s9", "s0_0", "B@1|root"), (None, "x", "B@1|root"), ("s1", None, "B@1|root")]
    packed = spark.createDataFrame(rows, "species string, gene string, groups string")
    known = [(s, g) for s, g, _ in rows if s and g]
    want = sorted({(min(a, b), max(a, b)) for s, a in known for t, b in known if s != t and a != b})
    for block in (7, 1024):
        found = paralogs.orthology_pairs(packed, 1, block)
        assert sorted(map(tuple, found.collect())) == want
    parts = paralogs.orthology_pairs(spark.createDataFrame([r for r in rows[:120]], packed.schema), 1, 7)
    sizes = [n for n in parts.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect() if n]
    assert len(sizes) > 8 and max(sizes) < len(want) / 4


def test_xi_of_pairs_by_blocks_against_ranks(spark, monkeypatch):
    """Several blocks and tasks, negative and inexact values, ties, cells without edges or values: as ranked row by row; no row for each pair and cell is planned."""
    from crossweave.operators import cell_blocks

    rng = np.random.default_rng(3)
    species = [f"s{i % 3}" for i in range(150)]
    cells = spark.createDataFrame([(i, s, "c") for i, s in enumerate(species)], "cell long, species string, cluster string")
    values = {(i, f"{s}_{g}"): float(rng.integers(-2, 4)) * (0.1 if g else 1.0) for i, s in enumerate(species) for g in range(4) if rng.random() < 0.5}
    edges = [(i, int(j), float(rng.integers(1, 4))) for i in range(140) for j in rng.choice(150, 3, replace=False)]
    expr = spark.createDataFrame([(species[i], i, g, v) for (i, g), v in values.items()], "species string, cell long, gene string, value double")
    graph = spark.createDataFrame(edges, "src long, dst long, weight double")
    pairs = [(f"s{a}_{g}", f"s{b}_{h}", f"s{a}", f"s{b}") for a in range(3) for b in range(a, 3) for g in range(4) for h in range(4) if (a, g) < (b, h)]
    monkeypatch.setattr(cell_blocks, "CELLS", 64)
    monkeypatch.setattr(refine, "RANKED", 200)
    got_frame = refine.xi_pairs(spark.createDataFrame(pairs, "g1 string, g2 string, s1 string, s2 string"), graph, expr, cells, 6)
    got = {(r["g1"], r["g2"]): r["corr"] for r in got_frame.collect()}
    mean = {(r["cell"], r["gene"]): round(r["value"], 6) for r in refine.averaged(graph, expr, cells).collect()}
    for g, h, s, t in pairs:
        own = [i for i in range(150) if species[i] in (s, t)]
        x, y = (np.array([mean.get((i, name), 0.0) for i in own]) for name in (g, h))
        r, l, n = (y[None] <= y[:, None]).sum(1), (y[None] >= y[:, None]).sum(1), len(own)
        d = 2 * (l * (n - l)).sum()
        want = 1 - n * np.abs(np.diff(r[np.argsort(x, kind="stable")])).sum() / d if d else 0.0
        assert abs(got[g, h] - want) < 1e-9
    assert len(got) == len(pairs)
    assert "Window" not in got_frame._jdf.queryExecution().toString()


def test_exact_neighbours_take_no_rows_but_the_best(spark):
    """Ties, copies, zero vectors, more tiles than one, own dataset: as by brute force; the search gives k rows for each cell and dataset by itself."""
    rng = np.random.default_rng(5)
    vectors = rng.integers(-1, 2, (90, 3)).astype(float)
    species = [f"s{i % 3}" for i in range(90)]
    latent = spark.createDataFrame([(f"c{i}", species[i], vectors[i].tolist()) for i in range(90)], "cell string, species string, vec array<double>")
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)
    cos = np.round(unit @ unit.T, 12)
    for other in (True, False):
        want = set()
        for i in range(90):
            for s in sorted(set(species)):
                if (s != species[i]) == other:
                    near = sorted((j for j in range(90) if species[j] == s and j != i), key=lambda j: (-cos[i, j], f"c{j}"))[:4]
                    want |= {(f"c{i}", f"c{j}", s, float(cos[i, j]) + 0.0) for j in near}
        for tile in (16384, 13):
            got = knn.nearest(latent, 4, other, tile)
            assert {(r["src"], r["dst"], r["dst_species"], r["cos"] + 0.0) for r in got.collect()} == want
            assert "Window" not in got._jdf.queryExecution().toString()


def test_projection_of_packed_cells_equals_joined_rows(world, spark, monkeypatch):
    """Also with a cell without expression, one that isn't among the cells, and a component that no feature in use has."""
    from crossweave.operators import latent

    cells = world["cells"].unionByName(spark.createDataFrame([("hu", "hu_bare", "0")], world["cells"].schema))
    expr = world["expr"].unionByName(spark.createDataFrame([("ms", "ms_other", "ms_g01", 3.0)], world["expr"].schema))
    loadings = world["loadings"].unionByName(spark.createDataFrame([("hu", "hu_none", 4, 1.0)], world["loadings"].schema))
    make = lambda: Mapping(expr, cells, world["genes"], world["graph"], loadings, edges=world["homology"])
    got = {r["cell"]: r["vec"] for r in make()._joint().collect()}
    monkeypatch.setattr(latent, "STEP", 7)
    monkeypatch.setattr(latent, "VALUES", 5 * 2 * G)
    small = {r["cell"]: r["vec"] for r in make()._joint().collect()}
    plan = make()._joint()._jdf.queryExecution().toString()
    assert "Exchange" not in plan.split("Physical Plan")[1]  # no shuffle of rows for each cell and feature
    monkeypatch.setattr(latent, "MOST_EDGES", 0)
    want = {r["cell"]: r["vec"] for r in make()._joint().collect()}
    assert got.keys() == want.keys() == small.keys() and "hu_bare" in got
    for c in want:
        assert np.allclose(got[c], want[c], atol=1e-9) and np.allclose(small[c], want[c], atol=1e-9)
