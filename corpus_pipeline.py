"""Corpus pipeline: five stages over whole documents, each stored as Parquet before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapeloom.llm import bpe
from tapeloom.llm.common import stored, table
from tapeloom.llm.line_runs import drop_common_lines
from tapeloom.llm.minhash import drop_near_duplicates
from tapeloom.llm.positional_index import drop_contaminated
from tapeloom.llm.string_kernel import keep_identified


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter or without a clear language; name the language where it is not given."""
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take lines of three or more documents out of all but the last of these."""
    return drop_common_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold benchmark passages."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with counts and digests of the ids and of what they decode to."""
    return bpe.round_trip(docs, *bpe.multi_50k(), keep_ids=True)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("tokenize", tokenize),
]

#: The language model's decisions and byte-pair merges have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
