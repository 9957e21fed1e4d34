"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, line_dedup, merkle, mixing, quality, secrets, sharding, simhash, token_counts, toxicity
from .common import fold
from .oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.remove_spread_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("clean_text").cast("binary"), 256).alias("clean_sha256"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edit_probe(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.toxicity(docs, model)
    return scored.select(
        "doc_id", (fold("doc_id") == 1).alias("held_out"), "score", F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted"), F.size("passages").cast("long").alias("n_passages")
    )


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
    return token_counts.token_counts(table(spark, sf_dir, "documents"), model)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, mixing.plan(docs))
    tokens = mixing.estimated_tokens(F.col("text"))
    return mixed.select("doc_id", "source", tokens.alias("n_tokens"), F.round("weight", 6).alias("weight"), "block", "copies")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold("doc_id") == 1).alias("held_out"), "score", F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0).alias("predicted"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = len(secrets.BASE)
    # a lambda of two arguments would get the position as its second
    counts = [F.size(F.expr(f"filter(spans, s -> s.rule = {i})")).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(secrets.BASE)]
    digest = F.sha2(secrets.written(F.filter("spans", lambda s: s["rule"] < base)).cast("binary"), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    # taken before the exchange, which then moves no texts
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    placed = sharding.shard(table(spark, sf_dir, "documents").withColumn("text_crc32", crc))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


QUERIES: dict[str, Query] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_toxicity": op4_toxicity,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_token_counts": op6_token_counts,
    "op7_source_mixing": op7_source_mixing,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_secret_scans": op9_secret_scans,
    "op10_sharding": op10_sharding,
}

ORACLE_SQL: dict[str, str] = {name: sql for name, sql in ORACLES.items() if name in QUERIES}
