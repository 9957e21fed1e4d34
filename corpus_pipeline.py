"""A training corpus from raw documents: five stages, each calling one operator.

Every function takes (spark, docs, sf_dir) and works on all that the stage before it kept.  All but
the last return the columns of documents.

In every stage null texts count as empty, null ids are rows of their own, repeated rows are decided
alike, long texts are read as a whole, an empty table gives an empty one, and further columns go along
whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gristmill.llm import decontaminate, mixing, quality, sharding, simhash
from gristmill.llm.common import discard, staged


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; an empty text is one empty line and goes by its score."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id: shingles of five words, similarity 0.8."""
    return simhash.keep_rows(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold a passage of the benchmark: 13 of its words in a row, or a twentieth of their own."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of small sources repeat until sources have their weights; each stays at least once."""
    return mixing.realised(docs, mixing.plan(docs)).drop("mix_order")


def shard_corpus(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with size, law, shard, slot and grown_shard; equal texts lie together."""
    return sharding.shard(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
    ("sharding", shard_corpus),
]

#: A conditional random field and SimHash are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(docs)  # a stage's table goes when the next one is written
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
