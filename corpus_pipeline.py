"""A training corpus from raw documents: toxic text out, one of each group of near copies, benchmark text out, mixed to source targets, sharded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from patchlight.llm import decontamination, jaccard, mixing, sharding, toxicity
from patchlight.llm.common import settled, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at Jaccard 0.8 stays."""
    return jaccard.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document in as many copies as its source's target takes."""
    return mixing.emit(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix."""
    return sharding.shard(docs).drop("row_no")


STAGES = [("toxicity", toxic), ("near_copies", near_copies), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shards)]

#: A trained classifier decides what stays; SQL cannot say that (tests/llm holds the run against brute force).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
