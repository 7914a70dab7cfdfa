"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing,
sharding.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all that the
stage before it kept; its result is written as Parquet and reread.  All stages
but the last return the columns of ``documents``; the last adds shard, slot
and what they follow from.  An empty table passes through all stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontaminate, mixing, orderminhash, qualityrules, sharding
from quarry.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep."""
    judged = qualityrules.judge(docs, keep=("text", "n_chars", "lang", "source"))
    return judged.filter("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return orderminhash.distinct_documents(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean_documents(docs.select(*COLUMNS), benchmark)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row per document and pass over it."""
    return mixing.mixed_documents(docs).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents with their shard and slot."""
    return sharding.shard_by_bytes(docs, shards=16, payload=("text", "lang", "source", "n_chars"))


STAGES = [
    ("quality rules", quality),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("sharding", shard),
]

# Sketches, alignment and permutations have no SQL form; the stages are tested
# against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline_{name.replace(' ', '_')}")
    return STAGES[-1][1](spark, docs, sf_dir)
