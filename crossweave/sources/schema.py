"""Schemas of the engine's tables, and the check of a table against one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from crossweave.exceptions import DataError

HITS = "query string, target string, pident double, length int, mismatch int, gapopen int, qstart int, qend int, sstart int, send int, evalue double, bitscore double"
TABLES = {
    "expr": "species string, cell string, gene string, value double",
    "cells": "species string, cell string, cluster string",
    "genes": "species string, gene string, weight double",
    "loadings": "gene string, pc int, value double",
    "graph": "src string, dst string, weight double",
    "homology": "g1 string, g2 string, s1 string, s2 string, weight double",
    "names": "header string, symbol string, ord long",
    "sets": "term string, gene string",
    "annotations": "species string, gene string, packed string",
}


def checked(table: DataFrame, name: str) -> DataFrame:
    """The table's known columns, cast; ``DataError`` if one is missing or the input is no table."""
    if not isinstance(table, DataFrame):
        raise DataError(f"{name}: a DataFrame is needed, not {type(table).__name__}")
    fields = StructType.fromDDL(TABLES[name]).fields
    missing = [f.name for f in fields if f.name not in table.columns]
    if missing:
        raise DataError(f"{name}: no column {', '.join(missing)}")
    extra = [c for c in table.columns if c not in {f.name for f in fields}]
    return table.select(*[table[f.name].cast(f.dataType).alias(f.name) for f in fields], *extra)
