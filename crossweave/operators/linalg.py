"""Linear algebra on long frames (i, j, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossweave.functions.numeric import guarded


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Σ_k a[i,k] b[k,j]: one equi-join and a sum that is combined before its shuffle."""
    left, right = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def hadamard(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.withColumnRenamed("v", "__v"), ["i", "j"]).select("i", "j", (F.col("v") * F.col("__v")).alias("v"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("i", "j").agg(F.sum("v").alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def by_row_max(a: DataFrame, *keys: str, value: str = "v") -> DataFrame:
    """Divide by the group's largest value (1 if that is 0)."""
    return a.withColumn(value, F.col(value) / guarded(F.max(value).over(Window.partitionBy(*keys))))


def by_row_sum(a: DataFrame, *keys: str, value: str = "v", below: float = 0.0) -> DataFrame:
    """Divide by the group's sum (1 if that is 0, or under ``below``)."""
    return a.withColumn(value, F.col(value) / guarded(F.sum(value).over(Window.partitionBy(*keys)), below))


def top_k(a: DataFrame, k: int, keys: list[str], value: str = "v", tie: list[str] | None = None) -> DataFrame:
    """The k largest values of each group, ties by ``tie``; k = 0 keeps everything. Planned as a group limit."""
    if k == 0:
        return a
    order = [F.desc(value), *(tie or [c for c in a.columns if c not in keys and c != value])]
    return a.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__rank") <= k).drop("__rank")


def top_k_each(a: DataFrame, budget: DataFrame, keys: list[str], value: str = "v", tie: list[str] | None = None) -> DataFrame:
    """As ``top_k`` with each group's own k (``budget``: keys, k); k = 0 keeps nothing."""
    order = [F.desc(value), *(tie or [c for c in a.columns if c not in keys and c != value])]
    ranked = a.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.join(budget.select(*keys, F.col("k").alias("__k")), keys).filter("__rank <= __k").drop("__rank", "__k")
