"""Annotated matrices as folders of text: ``matrix.mtx`` (coordinates), ``features.tsv`` and ``barcodes.tsv``, as most converters write them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.exceptions import DataError
from crossweave.functions.text import qualify

NAMES = "at long, name string"


def _names(spark: SparkSession, path: str) -> DataFrame:
    """at (from 1), name: the first column of each line. Lines are numbered where they are, without one task that reads all."""
    lines = spark.read.text(path).rdd.zipWithIndex().map(lambda x: (x[1] + 1, x[0][0].split("\t")[0]))
    return spark.createDataFrame(lines, NAMES)


def read_matrix(spark: SparkSession, folder: str, species: str, cells_by_row: bool = False) -> dict[str, DataFrame]:
    """expr, cells and genes of one dataset: the non-zeros with names for numbers, all cells (also those without a value), all features.

    Rows are features, as is usual, unless ``cells_by_row``. Names of features get the dataset's id before them; entries
    that occur more than once are added up; explicit zeros are left out; an entry beyond the names is an error."""
    base = folder.rstrip("/")
    genes = _names(spark, f"{base}/features.tsv").withColumn("gene", qualify(F.col("name"), F.lit(species))).drop("name")
    cells = _names(spark, f"{base}/barcodes.tsv").withColumnRenamed("name", "cell")
    lines = spark.read.text(f"{base}/matrix.mtx").filter(~F.col("value").startswith("%") & (F.trim("value") != ""))
    sizes = lines.first()
    if sizes is None:
        raise DataError(f"{base}/matrix.mtx has no sizes")
    rows, columns, entries = (int(x) for x in sizes["value"].split()[:3])
    part = F.split(F.trim("value"), r"\s+")
    # The line of sizes is none of the entries, which are as many as it says.
    numbers = lines.filter(F.col("value") != sizes["value"]).select(part[0].cast("long").alias("i"), part[1].cast("long").alias("j"), F.coalesce(F.get(part, F.lit(2)).cast("double"), F.lit(1.0)).alias("value"))
    found, most_i, most_j = numbers.agg(F.count(F.lit(1)), F.max("i"), F.max("j")).first()
    if found != entries or (most_i or 0) > rows or (most_j or 0) > columns or (genes.count(), cells.count()) != ((columns, rows) if cells_by_row else (rows, columns)):
        raise DataError(f"{base}: entries or names don't fit the sizes {sizes['value']}")
    gene_at, cell_at = ("j", "i") if cells_by_row else ("i", "j")
    sums = numbers.groupBy("i", "j").agg(F.sum("value").alias("value")).filter("value <> 0")
    expr = sums.join(genes, sums[gene_at] == genes["at"]).drop("at").join(cells, F.col(cell_at) == cells["at"])
    return {
        "expr": expr.select(F.lit(species).alias("species"), "cell", "gene", "value"),
        "cells": cells.select(F.lit(species).alias("species"), "cell"),
        "genes": genes.select(F.lit(species).alias("species"), "gene"),
    }
