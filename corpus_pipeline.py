"""The corpus pipeline: language ID, near-duplicate join, benchmark decontamination, secret scan, source mixing.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet and read again for the next.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import decontamination, language_id, mixing, near_duplicates, secrets
from tracewright.session import materialize, read_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects (no letter, or unlike every learned language) go."""
    return language_id.keep_identified(docs, language_id.train(docs))


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_duplicates.keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secrets.redact_history(docs)[0]


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of the documents that the mix takes."""
    return mixing.mix_sources(docs).where("copies > 0")


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", join_near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", scan_secrets),
    ("mixing", mix),
]
#: SQL cannot express the language model and the mix's budget fit; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to shared storage and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
