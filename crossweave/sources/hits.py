"""Tabular alignment hits: two files (one each way) for every pair of datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.constants import EVALUE_THRESHOLD
from crossweave.exceptions import HomologyError
from crossweave.operators import homology
from crossweave.sources.schema import HITS


def read_hits(spark: SparkSession, *paths: str) -> DataFrame:
    """Tab-separated hits of twelve columns without a header."""
    return spark.read.schema(HITS).option("sep", "\t").csv(list(paths))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file system that Spark knows has the path."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def pair_files(spark: SparkSession, folder: str, a: str, b: str) -> tuple[str, str]:
    """The files of a to b and b to a, in ``<ab>`` or ``<ba>``."""
    for name in (f"{a}{b}", f"{b}{a}"):
        if exists(spark, f"{folder.rstrip('/')}/{name}"):
            base = f"{folder.rstrip('/')}/{name}"
            return f"{base}/{a}_to_{b}.txt", f"{base}/{b}_to_{a}.txt"
    raise HomologyError(f"{folder} has neither {a}{b} nor {b}{a}")


def read_homology(spark: SparkSession, folder: str, species: list[str], evalue: float = EVALUE_THRESHOLD, reciprocal: bool = True, drop_missing_tokens: bool = False) -> DataFrame:
    """The homology graph of all pairs of datasets."""
    graphs = []
    for i, a in enumerate(species):
        for b in species[i + 1 :]:
            there, back = pair_files(spark, folder, a, b)
            one = homology.qualified_hits(homology.usable_hits(read_hits(spark, there), evalue, drop_missing_tokens), F.lit(a), F.lit(b))
            two = homology.qualified_hits(homology.usable_hits(read_hits(spark, back), evalue, drop_missing_tokens), F.lit(b), F.lit(a))
            graphs.append(homology.graph(one, two, reciprocal))
    return reduce(DataFrame.unionByName, graphs)
