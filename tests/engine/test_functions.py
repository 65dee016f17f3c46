import math

import pytest
from pyspark.sql import functions as F

from crossweave import constants, exceptions, log
from crossweave.functions import numeric, text
from crossweave.operators import datasets, linalg, pairs


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_pairs_as_strings(spark):
    df = spark.createDataFrame([("a", "b"), ("c", "d"), ("e", "f")], "a string, b string")
    assert [r[0] for r in df.select(text.encode_pair(F.col("a"), F.col("b"))).collect()] == ["a;b", "c;d", "e;f"]
    assert df.limit(0).select(text.encode_pair(F.col("a"), F.col("b"))).count() == 0
    assert spark.createDataFrame([("gene1", "gene2")], "a string, b string").select(text.encode_pair(F.col("a"), F.col("b"))).first()[0] == "gene1;gene2"
    a, b = text.decode_pair(F.col("x"))
    df = spark.createDataFrame([("gene1;gene2",), ("gene3;gene4",)], "x string")
    assert [tuple(r) for r in df.select(a, b).collect()] == [("gene1", "gene2"), ("gene3", "gene4")]


def test_parts(spark):
    names = ["hu_SOX2", "ms_Oct4", "hu_NANOG"]
    assert column(spark, names, lambda x: text.part(x, "_", 0)) == ["hu", "ms", "hu"]
    assert column(spark, names, lambda x: text.part(x, "_", 1)) == ["SOX2", "Oct4", "NANOG"]
    assert column(spark, ["hu_SOX2", "ms"], lambda x: text.part(x, "_", 5)) == ["SOX2", "ms"]
    df = spark.createDataFrame([("a_b_c",), ("d_e_f",), ("g",)], "x string")
    assert [tuple(r) for r in df.select(*text.parts(F.col("x"), "_", 3)).collect()] == [("a", "b", "c"), ("d", "e", "f"), ("g", "", "")]


def test_names(spark):
    assert column(spark, ["SOX2", "hu_SOX2", "hu2_x"], lambda x: text.qualify(x, F.lit("hu"))) == ["hu_SOX2", "hu_SOX2", "hu_hu2_x"]
    assert column(spark, ["hu_a_b", "plain"], text.strip_species) == ["a_b", "plain"]
    assert column(spark, ["a,b", "a,,b", "x"], lambda x: text.unpack(x, ",")) == [["a", "b"], ["a", "b"], ["x"]]
    assert column(spark, ["A1b-C", "", None], lambda x: text.unpack(x, "")) == [["A", "b", "C"], [], None]
    packed = "OG1@2759|x,OG2@33|y,OG3@1|root"
    assert column(spark, [packed, packed + ",OG4@2759|z", "OG5@27|q"], lambda x: text.groups_at(x, 2759)) == [["OG1"], [], []]
    assert column(spark, [packed + ",OG4@33|z"], lambda x: text.groups_at(x, 33)) == [["OG2", "OG4"]]


def test_arrays_by_key(spark):
    rows = [("geneA", 1), ("geneA", 2), ("geneB", 3), ("geneC", 4), ("geneC", 5), ("geneC", 6)]
    df = spark.createDataFrame(rows, "gene string, value int")
    assert {r["gene"]: r["values"] for r in pairs.to_arrays(df, "gene", "value").collect()} == {"geneA": [1, 2], "geneB": [3], "geneC": [4, 5, 6]}


def test_top_k(spark):
    rows = [(i, j, float(v)) for i, row in enumerate([[1, 5, 2, 4], [3, 8, 1, 6]]) for j, v in enumerate(row)]
    df = spark.createDataFrame(rows, "i int, j int, v double")
    kept = linalg.top_k(df, 2, ["i"])
    got = {}
    for r in kept.collect():
        got.setdefault(r["i"], set()).add(r["v"])
    assert got == {0: {5.0, 4.0}, 1: {8.0, 6.0}}
    assert linalg.top_k(df, 0, ["i"]).count() == 8
    budget = spark.createDataFrame([(0, 3), (1, 0)], "i int, k int")
    assert sorted((r["i"], r["v"]) for r in linalg.top_k_each(df, budget, ["i"]).collect()) == [(0, 2.0), (0, 4.0), (0, 5.0)]
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()


def test_products(spark):
    a = spark.createDataFrame([(0, 0, 2.0), (0, 1, 1.0), (1, 1, 3.0)], "i int, j int, v double")
    assert sorted(map(tuple, linalg.matmul(a, a).collect())) == [(0, 0, 4.0), (0, 1, 5.0), (1, 1, 9.0)]
    assert sorted(map(tuple, linalg.hadamard(a, linalg.transpose(a)).collect())) == [(0, 0, 4.0), (1, 1, 9.0)]
    assert sorted(map(tuple, linalg.add(a, linalg.transpose(a)).collect())) == [(0, 0, 4.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 6.0)]
    zero = spark.createDataFrame([(0, 0, 0.0)], "i int, j int, v double")
    assert linalg.by_row_sum(zero, "i").first()["v"] == 0.0 and linalg.by_row_max(zero, "i").first()["v"] == 0.0


def test_numbers(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (float("nan"),), (None,)], "x double")
    assert df.select(numeric.tanh_scale(F.col("x"))).first()[0] == 0.5
    assert [r[0] for r in df.select(numeric.floored(F.col("x"))).collect()] == [0.5, 1.0, 1e-3, 1e-3]
    lf = {r["n"]: r["lf"] for r in spark.sql("SELECT explode(concat(sequence(0, 200), array(1000000, 1000000000))) AS n").select("n", numeric.ln_factorial(F.col("n")).alias("lf")).collect()}
    assert all(math.isclose(lf[n], math.lgamma(n + 1), rel_tol=1e-12, abs_tol=1e-12) for n in lf)
    z = spark.createDataFrame([(0.0,), (1.959963984540054,), (-3.0,)], "z double")
    p = [r[0] for r in z.select(numeric.normal_tail_two_sided("z")).collect()]
    assert p[0] == 1.0 and math.isclose(p[1], 0.05, rel_tol=1e-9) and math.isclose(p[2], math.erfc(3 / math.sqrt(2)))
    assert numeric.hex_to_rgb("#ff0080") == (1.0, 0.0, 128 / 255)


def test_constants(spark):
    assert (constants.EVALUE_THRESHOLD, constants.PRUNE_THRESHOLD, constants.ITERATIONS, constants.NEIGHBOURS, constants.HOPS) == (1e-6, 0.25, 3, 20, 3)
    assert len(constants.CATEGORIES) == 25 and "X" not in constants.CATEGORIES
    assert datasets.categories(spark).count() == 25


@pytest.mark.parametrize("error, builtin", [(exceptions.HomologyError, FileNotFoundError), (exceptions.MappingError, RuntimeError), (exceptions.DataError, TypeError), (exceptions.SpeciesNotFoundError, KeyError), (exceptions.GeneNotFoundError, ValueError), (exceptions.DependencyError, ImportError)])
def test_errors(error, builtin):
    with pytest.raises(builtin, match="why"):
        raise error("why")
    assert issubclass(error, exceptions.CrossweaveError)


def test_logging(caplog):
    log.setup_logging()
    log.get_logger("x").info("hello")
    assert log.get_logger("x").name == "crossweave.x"
