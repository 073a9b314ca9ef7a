"""The corpus pipeline: stages over documents, each calling one operator of sparkweave.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkweave.llm import decontam, mixing, sharding, simhash, toxicity
from sparkweave.llm.common import discard, stage

#: SQL has no fitted models, XXH64 fingerprints or seeded hash ranks: the stages are tested against brute force instead.
ORACLE_SQL = None


def detoxify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labelled ones, rejects go."""
    return toxicity.drop(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.drop(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix of sources takes it."""
    return mixing.repeat(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each with its shard and the slot in it."""
    return sharding.place(docs)


STAGES = [("toxicity", detoxify), ("simhash", deduplicate), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, one after the other, each written before the next reads it and deleted after that."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


def write(spark: SparkSession, sf_dir: str, path: str, files: int = 1) -> None:
    """run(), written by shard, in the order of the slots."""
    sharding.write(run(spark, sf_dir), path, files)
