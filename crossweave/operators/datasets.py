"""Datasets side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.constants import CATEGORIES


def concatenated(tables: dict[str, DataFrame], labels: list[str]) -> DataFrame:
    """Cells of all datasets: each label column becomes ``<dataset>_<label>``, "unassigned" for other datasets' cells; ``batch`` numbers the datasets."""
    made = []
    for i, (species, table) in enumerate(tables.items(), 1):
        renamed = [F.col(c).cast("string").alias(f"{species}_{c}") if c in labels else F.col(c) for c in table.columns if c not in ("species", "batch")]
        made.append(table.select(F.lit(species).alias("species"), F.lit(f"batch{i}").alias("batch"), *renamed))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), made)
    return every.na.fill("unassigned", [c for c in every.columns if any(c == f"{s}_{x}" for s in tables for x in labels)])


def of_species(table: DataFrame, species: list[str]) -> DataFrame:
    return table.filter(F.col("species").isin(species))


def categories(spark: SparkSession) -> DataFrame:
    """term, description: the functional categories (25 rows)."""
    return spark.createDataFrame(list(CATEGORIES.items()), "term string, description string")
