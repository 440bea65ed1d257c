"""From raw documents to packed training sequences, one operator a stage.

Stages take and return the columns of documents; the last returns the pieces of sequences. Nulls, empty texts and
repeated rows are dealt with as each operator says; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plansmith.llm import line_dedup, near_dedup, packing, quality, secret_scan
from plansmith.llm.common import stored, table
from plansmith.llm.tokenizing import vocabulary_path


def _measured(docs: DataFrame, out: DataFrame) -> DataFrame:
    """The columns of docs, with n_chars as the text now has them."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents share stay in the last of them."""
    return _measured(docs, line_dedup.dedup_lines(docs))


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return near_dedup.keep_one(docs)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts."""
    found, _ = secret_scan.find_secrets(docs)
    return _measured(docs, found.withColumn("text", secret_scan.redact(F.col("text"), F.col("secret_spans"))))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.pack(docs, vocabulary_path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_rules),
    ("line_dedup", line_deduplication),
    ("near_dedup", near_deduplication),
    ("secrets", secret_redaction),
    ("packing", sequence_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Perplexity, near-duplicate components and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None
