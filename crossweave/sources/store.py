"""Sessions on disk: a folder with a Parquet table for each frame, and a manifest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

MANIFEST = "manifest"
#: The manifest's row for what isn't a table.
SETTINGS = "."


def save(spark: SparkSession, tables: dict[str, DataFrame], folder: str, settings: dict | None = None) -> None:
    """Write all tables, the manifest (with the settings) last."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
    rows = [(name, table.schema.json()) for name, table in tables.items()] + [(SETTINGS, json.dumps(settings or {}))]
    spark.createDataFrame(rows, "name string, schema string").coalesce(1).write.mode("overwrite").json(f"{folder}/{MANIFEST}")


def _manifest(spark: SparkSession, folder: str) -> dict[str, dict]:
    rows = spark.read.schema("name string, schema string").json(f"{folder}/{MANIFEST}").collect()
    return {r["name"]: json.loads(r["schema"]) for r in rows}


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(StructType.fromJson(schema)).parquet(f"{folder}/{name}") for name, schema in _manifest(spark, folder).items() if name != SETTINGS}


def load_settings(spark: SparkSession, folder: str) -> dict:
    return _manifest(spark, folder).get(SETTINGS, {})
