"""The corpus pipeline: five operators in a row over ``documents``.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet in the shared checkpoint folder and read
again as the next stage's ``docs``. Toxic documents go, then those that fail the quality rules, then all but one
document of each group of near-duplicates, then passages that an earlier document has. All these return the
columns of ``documents``. The last stage packs what is left into sequences and returns the pieces.

Defined results, stage by stage (the operators' own docstrings say more): null and empty texts are clean, fail the
quality rules and so end there; very long texts are worked on whole; rows without doc_id, or that share one, are told
apart by their texts; of repeated rows one is left after the near-duplicates; ties go to the smaller doc_id, then
the lesser text hash; extra columns, whatever their names, are carried up to the last stage; without labels nothing
is toxic; empty tables give an empty result. A stage's result replaces that of the one before in the checkpoint
folder; only the pieces stay, as the result reads them.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from crossweave.llm import packing, quality_rules, simhash, suffix_dedup, toxicity
from crossweave.llm.common import release, remove, stored, table, with_checkpoint_dir

TOKENIZER = "byte_bpe_50k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.strip(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("simhash", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_passages),
    ("packing", pack),
]

#: Learnt weights, hashes of words and tokenisation are no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed corpus."""
    with_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        mark = stored()
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        release(spark, mark)
        if before is not None:
            remove(spark, f"{folder}/{before}")
        docs, before = spark.read.parquet(f"{folder}/{name}"), name
    packed = STAGES[-1][1](spark, docs, sf_dir)
    remove(spark, folder)  # the pieces are stored
    return packed
