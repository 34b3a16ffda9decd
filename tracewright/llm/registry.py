"""Registered queries of the text-pipeline operators: whole tables, production parameters."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..session import read_table, shared_dir
from . import chat, decontamination, divergence, filter_audit, language_id, language_model, licenses, media, mixing, near_duplicates, oracles, secrets, token_counts, token_files


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from the labelled documents that are not held out."""
    docs = _documents(spark, sf_dir)
    return language_id.identify(docs, language_id.train(docs))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text, through the blob ledger."""
    return secrets.secret_digest(secrets.scan_history(_documents(spark, sf_dir))[0])


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as PNG, read back, with checksums and a cosine hash."""
    return media.media_digest(media.decode_media(media.encode_media(_documents(spark, sf_dir))))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text under the 50k byte-level vocabulary."""
    return token_counts.count_tokens(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in every text."""
    return decontamination.contaminated(_documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a weighted mix takes from every document."""
    return mixing.mix_sources(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations of the log, rendered."""
    return chat.format_chats(read_table(spark, sf_dir, "conversations"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked group and number of links of every text."""
    return near_duplicates.join_near_texts(_documents(spark, sf_dir))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and signatures in every text."""
    return licenses.license_digest(licenses.scan_licenses(_documents(spark, sf_dir)))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and log-bilinear log-probabilities of every text."""
    return language_model.score_texts(_documents(spark, sf_dir))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source from the others of its language, and its most over-used terms."""
    return divergence.source_divergence(_documents(spark, sf_dir))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in token-ID files of directly addressable codes, read back."""
    path = shared_dir(spark)
    token_files.write_token_files(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), path)
    return token_files.token_digest(token_files.read_token_files(spark, path))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every filter removes at every step of every order."""
    return filter_audit.audit_filters(_documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_secret_scans": op2_secret_scans,
    "op3_media_columns": op3_media_columns,
    "op4_token_counts": op4_token_counts,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_mix_sources": op6_mix_sources,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_license_scans": op9_license_scans,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_source_divergence": op11_source_divergence,
    "op12_token_files": op12_token_files,
    "op13_filter_audit": op13_filter_audit,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op2_secret_scans": oracles.SECRETS,
    "op7_chat_formatting": oracles.CHATS,
    "op8_jaccard_join": oracles.JOIN,
    "op11_source_divergence": oracles.DIVERGENCE,
    "op13_filter_audit": oracles.FILTERS,
}
