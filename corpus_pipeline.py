"""The corpus pipeline: quality rules, near-dedup, substring dedup, secret redaction, packing.

Every stage works on all its predecessor kept and returns the columns of documents, but for the last, whose rows
are pieces of packed sequences. Stages' results are Parquet in the folder of spark.checkpoint.dir.

Rows are told apart by doc_id and a hash of their text, never by doc_id alone: rows of equal or null doc_id are documents
of their own. Of wholly equal rows near-dedup keeps one. Null, empty and very short texts are rejected by the quality
rules; very long texts are worked on whole. An empty table gives no pieces. Other columns, whatever their names, pass
through all stages but the last, which names its pieces by doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import packing, phrases, quality, secrets, simhash
from quarry.llm.common import Stage
from quarry.llm.queries import BYTE_BPE


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality.quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, similarity of 0.8."""
    return simhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that occurred before are removed from texts."""
    return phrases.drop_repeats(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mask."""
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with their ids as little-endian unsigned 32-bit integers."""
    return packing.pack_documents(docs, BYTE_BPE, "bytes", end_id=0, cached_words=150_000)  # workers share memory with what earlier stages left


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_dedup), ("substring dedup", substring_dedup), ("secret scans", secret_scan), ("packing", pack)]

#: Tokens, components and passages of whole texts are beyond SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage, docs = Stage(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES:
        docs = stage.write(step(spark, docs, sf_dir))
    return docs
