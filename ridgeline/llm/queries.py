"""The thin op queries: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, hard_negatives, html, jaccard, nearest, pii, quality, secrets, sstable, substrings, toxicity, vafile


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = sstable.write_shards(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0)
    return sstable.read_shards(spark, manifest)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return secrets.digest_scan(docs, secrets.train(docs))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents")).drop("fp")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_scan(read(spark, sf_dir, "documents"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents"), percent=85, words=4)


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return html.extract(pages, html.train(pages))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.quantise(read(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label").cast("bigint"))
    return hard_negatives.mine(read(spark, sf_dir, "embeddings").withColumn("label", moved))


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontaminate, op2_token_shards, op3_secrets, op4_byte_bpe, op5_quality, op6_pii, op7_jaccard, op8_substrings, op9_toxicity, op10_html, op11_vector_codes, op12_hard_negatives, op13_nearest)
}
ORACLES: dict[str, str] = {"op5_quality": quality.ORACLE, "op11_vector_codes": vafile.sql(), "op12_hard_negatives": hard_negatives.ORACLE, "op13_nearest": nearest.ORACLE}
