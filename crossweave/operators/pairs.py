"""Pairs of names, and values gathered by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossweave.functions.text import unordered


def canonical(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distinct unordered pairs (a <= b)."""
    low, high = unordered(F.col(a), F.col(b))
    return pairs.select(low.alias("a"), high.alias("b")).distinct()


def both_ways(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distinct ordered pairs of the symmetric closure."""
    there, back = F.struct(F.col(a).alias("a"), F.col(b).alias("b")), F.struct(F.col(b).alias("a"), F.col(a).alias("b"))
    return pairs.select(F.explode(F.array(there, back)).alias("p")).select("p.a", "p.b").distinct()


def to_arrays(table: DataFrame, key: str, *values: str) -> DataFrame:
    """key, values: the sorted values of each key, those of several columns together."""
    every = F.flatten(F.collect_list(F.array(*[F.col(v) for v in values])))
    return table.groupBy(key).agg(F.array_sort(every).alias("values"))


def without(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Unordered pairs that aren't among the known ones."""
    return canonical(pairs).join(canonical(known), ["a", "b"], "left_anti")
