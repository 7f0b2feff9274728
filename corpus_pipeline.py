"""A training corpus from raw documents, in five stages.

Toxic documents go; one document of each near-duplicate group stays; documents that hold a benchmark item go; sources
are mixed to their target weights (documents may repeat); what is left gets a shard and a slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewater.llm import decontaminate, jaccard_join, mixing, sharding, toxicity
from tidewater.sources.scratch import discard, materialize

SHARDS = 40


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under the threshold by models fitted on the labelled rows outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(toxicity.remainder(F.col("doc_id"), 3) != 1)
    model = toxicity.fit(docs, labels)
    return docs.where(toxicity.score(F.col("text"), model) < toxicity.THRESHOLD)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.deduplicated(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in order of virtual finish time; a document stands as often as it is taken."""
    return mixing.mix(docs).drop("mix_pass", "virtual_finish")


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("toxicity", remove_toxic),
    ("ngram_jaccard_join", remove_near_duplicates),
    ("benchmark_decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: The models of the first stage cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read again, then deleted when the next one's is there."""
    docs, stored = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(*stored)
        stored = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
