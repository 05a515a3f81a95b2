"""Queries of this subpackage for the entry module, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, jaccard, merkle, mixing, neardup, packing, quality, secrets, shards, suffix, toxicity, whitening


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(_read(spark, sf_dir, "conversations"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_read(spark, sf_dir, "documents"), n=4, limit=jaccard.Threshold(85, 100))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_by_bytes(_read(spark, sf_dir, "documents"), 24)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.risk_controlled(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_report(_read(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_report(_read(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_report(_read(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_formatting,
        op2_ngram_jaccard_join,
        op3_sharding,
        op4_quality_rules,
        op5_toxicity,
        op6_suffix_array_dedup,
        op7_bpe,
        op8_embedding_near_dedup,
        op9_best_fit_packing,
        op10_secret_scans,
        op11_merkle_manifest,
        op12_embedding_whitening,
        op13_source_mixing,
    )
}
ORACLE_SQL: dict[str, str] = {"op1_chat_formatting": chat.ORACLE, "op4_quality_rules": quality.ORACLE, "op10_secret_scans": secrets.ORACLE, "op11_merkle_manifest": merkle.ORACLE}
