"""Translation and projection cell by cell: as rows for each cell and feature, translated expression would be a multiple of its input.

Two passes over packed cells, neither with a shuffle of them: sums of the translated features, then the components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossweave.operators import expression

#: Features and edges that a task can hold; beyond them rows are joined.
MOST_FEATURES = 1 << 16
MOST_EDGES = 1 << 22
#: Values of the dense matrix of some cells, and products of values and edges that are added at a time.
VALUES = 1 << 21
STEP = 1 << 20


def packed(expr: DataFrame, cells: DataFrame, names: list[str]) -> DataFrame:
    """species, cell, own, codes, values: each cell's features by number; ``own``: it is one of ``cells``."""
    codes = F.broadcast(expr.sparkSession.createDataFrame(list(zip(names, range(len(names)))), "gene string, code int"))
    lists = expr.filter("value IS NOT NULL").join(codes, "gene").groupBy("species", "cell").agg(F.collect_list(F.struct("code", F.col("value").cast("double").alias("value"))).alias("x"))
    lists = lists.select("species", "cell", F.col("x.code").alias("codes"), F.col("x.value").alias("values"))
    every = cells.select("species", "cell", F.lit(True).alias("own"))
    return every.join(lists, ["species", "cell"], "full").withColumn("own", F.coalesce("own", F.lit(False)))


class _Graph:
    """Features' factors by dataset, and edges to other features."""

    def __init__(self, factors: np.ndarray, g1: np.ndarray, g2: np.ndarray, weight: np.ndarray, species: list[str]) -> None:
        order = np.argsort(g1, kind="stable")
        self.factors, self.to, self.weight, self.species = factors, g2[order], weight[order], species
        self.start = np.searchsorted(g1[order], np.arange(factors.shape[1] + 1))

    def parts(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Place of the first cell, datasets of the cells, and their own scaled values and translated ones, cells x features."""
        features = self.factors.shape[1]
        kind = pc.index_in(batch.column("species"), value_set=pa.array(self.species)).to_numpy(zero_copy_only=False).astype(np.int64)
        length = pc.fill_null(pc.list_value_length(batch.column("codes")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        codes, values = batch.column("codes").flatten().to_numpy(), batch.column("values").flatten().to_numpy()
        ends = np.concatenate(([0], np.cumsum(length)))
        step = max(1, VALUES // features)
        for a in range(0, batch.num_rows, step):
            b = min(a + step, batch.num_rows)
            row = np.repeat(np.arange(b - a), length[a:b])
            code = codes[ends[a] : ends[b]].astype(np.int64)
            x = values[ends[a] : ends[b]] * self.factors[kind[a:b][row], code]
            own = np.bincount(row * features + code, x, (b - a) * features)
            moved = np.zeros((b - a) * features)
            many = self.start[code + 1] - self.start[code]
            total = np.cumsum(many)
            cuts = np.unique(np.searchsorted(total, np.arange(STEP, total[-1] if len(total) else 0, STEP)))
            for i, j in zip([0, *cuts], [*cuts, len(code)]):
                n = many[i:j]
                of = np.repeat(np.arange(i, j), n)
                edge = np.arange(len(of)) + np.repeat(self.start[code[i:j]] - (np.cumsum(n) - n), n)
                moved += np.bincount(row[of] * features + self.to[edge], x[of] * self.weight[edge], len(moved))
            yield a, kind[a:b], own.reshape(b - a, features), moved.reshape(b - a, features)


def joint(packed: DataFrame, expr: DataFrame, cells: DataFrame, genes: DataFrame, homology: DataFrame, loadings: DataFrame, names: list[str], species: list[str]) -> DataFrame:
    """cell, species, vec: as scaled values and those carried along ``homology``, scaled again, projected on ``loadings(gene, pc, value)`` and
    centred by dataset; components that no feature in use has are left out, and datasets without any."""
    spark, features = expr.sparkSession, len(names)
    code, number = {g: i for i, g in enumerate(names)}, {s: i for i, s in enumerate(species)}
    cell = cells.schema["cell"].dataType.simpleString()

    def placed(rows: list, value: str) -> np.ndarray:
        out = np.zeros((len(species), features))
        for r in rows:
            if r["gene"] in code and r["species"] in number:
                out[number[r["species"]], code[r["gene"]]] = r[value]
        return out

    first = placed(expression.factors(expr, cells, genes).collect(), "__f")
    edges = homology.filter("s1 <> s2").select("g1", "g2", F.col("weight").cast("double").alias("weight")).toArrow()
    known = pa.array(names, pa.string())
    ends = [pc.fill_null(pc.index_in(edges[c].cast(pa.string()), value_set=known), -1).to_numpy().astype(np.int64) for c in ("g1", "g2")]
    there = (ends[0] >= 0) & (ends[1] >= 0)
    graph = spark.sparkContext.broadcast(_Graph(first, ends[0][there], ends[1][there], edges["weight"].to_numpy()[there], species))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = graph.value
        total = np.zeros((4, len(g.species) * features))
        for batch in batches:
            for _, kind, *parts in g.parts(batch):
                for s in np.unique(kind):
                    at, mine = slice(s * features, (s + 1) * features), kind == s
                    for k, part in enumerate(parts):
                        total[2 * k, at] += part[mine].sum(0)
                        total[2 * k + 1, at] += (part[mine] ** 2).sum(0)
        some = np.flatnonzero(total[1::2].any(0))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(x[some]) for x in total)], names=["at", "s0", "q0", "s1", "q1"])

    every = ["s0", "q0", "s1", "q1"]
    found = packed.mapInArrow(sums, "at long, s0 double, q0 double, s1 double, q1 double").groupBy("at").agg(*[F.sum(c).alias(c) for c in every]).collect()
    made = np.zeros((4, len(species) * features))
    for r in found:
        made[:, r["at"]] = [r[c] for c in every]
    s0, q0, s1, q1 = made.reshape(4, len(species), features)
    n = placed([], "n")
    for r in expression.cell_counts(cells).collect():
        if r["species"] in number:
            n[number[r["species"]]] = r["n"]
    weight = np.zeros(features)
    for r in genes.select("gene", "weight").collect():
        if r["gene"] in code:
            weight[code[r["gene"]]] = r["weight"]
    cellsof = np.maximum(n, 1)
    sd = np.sqrt(np.maximum(q1 / cellsof - (s1 / cellsof) ** 2, 0.0))
    second = weight / np.where(sd == 0, 1.0, sd)
    used = (q0 > 0) | (q1 > 0) & (second != 0)
    axes = [(code[r["gene"]], r["pc"], r["value"]) for r in loadings.collect() if r["gene"] in code and used[:, code[r["gene"]]].any()]
    order = {p: i for i, p in enumerate(sorted({p for _, p, _ in axes}))}
    axis = np.zeros((features, len(order)))
    for g, p, v in axes:
        axis[g, order[p]] += v
    loaded = np.zeros(features, bool)
    loaded[[g for g, _, _ in axes]] = True
    kept = (used & loaded).any(1)
    mean = (s0 + s1 * second) @ axis / cellsof[:, :1]
    fitted = spark.sparkContext.broadcast((second, axis, mean, kept))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        second, axis, mean, kept = fitted.value
        for batch in batches:
            for a, kind, own, moved in graph.value.parts(batch):
                vec = (own + moved * second[kind]) @ axis - mean[kind]
                some = np.flatnonzero(kept[kind] & batch.column("own").slice(a, len(kind)).to_numpy(zero_copy_only=False))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * axis.shape[1], pa.int32()), pa.array(vec[some].ravel()))
                at = pa.array(a + some)
                yield pa.RecordBatch.from_arrays([batch.column("cell").take(at), batch.column("species").take(at), lists], names=["cell", "species", "vec"])

    return packed.mapInArrow(project, f"cell {cell}, species string, vec array<double>")
