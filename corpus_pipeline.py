"""A corpus pipeline: documents go through five stages, each written and read again.

Toxic documents are rejected, one document of each near-duplicate group stays, repeated
passages are cut out, secrets are replaced by their kind, and what is left is packed into
training sequences. Every stage takes null and empty texts, repeated rows and ids, null ids,
empty tables and any further columns; all but the last keep the columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.llm import jaccard, packing, secrets, suffix, toxicity
from sheetloom.llm._util import shared_folder

#: Bytes of a repeated passage; passages of over 50 words are longer.
PASSAGE = 240


def _sized(docs: DataFrame) -> DataFrame:
    """Bring n_chars up to date where the table has it."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scoring one half or more go; the network learns from the labelled ones.

    Null and empty texts are scored like others; equal texts get equal scores.
    """
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by chains of links (five-word shingles, Jaccard of at least 0.8), the one with the smallest doc_id stays.

    Texts without words are groups of their own and stay; of equal rows one stays.
    """
    return jaccard.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte of a string of PASSAGE bytes that starts anywhere else goes.

    All rows stay, with an empty text where all of it repeats; null texts stay null.
    """
    return _sized(suffix.remove_repeats(docs, PASSAGE))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of secrets become their kind in brackets; all rows stay, null texts null."""
    return _sized(secrets.redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences; a null or empty text is one token, its end.

    Rows that are alike are packed each on its own.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack_sequences),
]
#: The network and the packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's result is a table in the shared checkpoint folder."""
    shared = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared}/pipeline-{uuid.uuid4()}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
