"""The registered queries of the corpus operators, with production parameters, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chosenpath, decontam, filteraudit, langid, linedup, merkle, mixing, pii, recompression, sharding, simhash, suffix, tokens
from .common import table
from .oracles import ORACLES  # noqa: F401

#: The key of the registered query; a deployment passes its own secret to pseudonymize().
KEY = "demonstration key"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item: one row per document and item."""
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edited_likeness(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_bytes(table(spark, sf_dir, "documents"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokens_round_trip(table(spark, sf_dir, "documents"), TOKENIZER)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, usable=~langid.held_out())
    return langid.predict(docs.withColumn("held_out", langid.held_out()), model, "doc_id", "held_out")


def op6_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosenpath.near_duplicates(table(spark, sf_dir, "documents")).drop("th", "first")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix_sources(table(spark, sf_dir, "documents")))


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data and secrets replaced."""
    return pii.pseudonymize(table(spark, sf_dir, "documents"), KEY)


def op9_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.dedup_words(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, and the numbers of those that an earlier line of the corpus makes redundant."""
    return linedup.line_counts(table(spark, sf_dir, "documents"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.documents_by_shard(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_simhash": op2_simhash,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_token_output": op4_token_output,
    "op5_language_id": op5_language_id,
    "op6_chosen_path": op6_chosen_path,
    "op7_source_mixing": op7_source_mixing,
    "op8_surrogates": op8_surrogates,
    "op9_recompression": op9_recompression,
    "op10_line_dedup": op10_line_dedup,
    "op11_sharding": op11_sharding,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_filter_audit": op13_filter_audit,
}
