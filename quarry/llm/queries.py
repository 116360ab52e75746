"""The registered queries of the corpus operators: production parameters over whole tables, contract columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embed_ego, oracles, packing, phrases, piece_samples, quality, reply_trees, secrets, simhash, token_blocks, url_templates
from .common import table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_gumbel_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = piece_samples.sample_pieces(table(spark, sf_dir, "documents"), PIECES, k=2, decoded=True)
    return found.select("doc_id", "sample", "n_tokens", F.crc32("ids").alias("ids_crc32"), "text_chars", "text_crc32", "log_prob", "perturbed", "inclusion")


def op2_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.token_blocks(table(spark, sf_dir, "documents"), WORD_BPE, "words", end_id=2)


def op3_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], rows.schema)
    return reply_trees.read_back(reply_trees.reply_conversations(reply_trees.chain_nodes(rows.unionByName(own))))


def op5_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))

    def n(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [n(kind) for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op5 that SQL can express: its base spans."""
    return op5_secret_links(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def op6_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_ego.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_measures(table(spark, sf_dir, "documents")).drop("rejected_by")


def op8_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), BYTE_BPE, "bytes", end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window", "step")


def op9_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.repeated_words(table(spark, sf_dir, "documents"))


def op10_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    out = {k: v for k, v in globals().items() if k.startswith("op") and callable(v) and k[2].isdigit()}
    return dict(sorted(out.items())) | {"secret_base": secret_base}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
