"""The corpus pipeline: quality rules, exact dedup, near dedup, source mixing, BPE encoding, in that order.

Each stage takes what its predecessor kept, read back from Parquet, and returns the same columns; the last returns token
ids. Decisions take effect: rejected documents, copies and near copies are gone after their stage, and a document that
the mix takes twice is there twice.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tradesift.llm import bpe, common, exact_dedup, quality_rules, simhash_dedup, source_mixing

#: SQL can express neither SimHash components nor BPE; tests hold the stages against brute force.
ORACLE_SQL = None
RANKS = "byte_bpe_multi_50k.tiktoken"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the threshold table."""
    return quality_rules.keep_good(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest doc_id."""
    return simhash_dedup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix takes them."""
    return source_mixing.repeat_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip."""
    return bpe.with_ids(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_good),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what a stage leaves in the shared folder goes once its output is stored."""
    docs, stored = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = common.scratch_path(spark, f"stage-{name}")
        with common.scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        if stored:
            common.delete_path(spark, stored)
        docs, stored = spark.read.schema(out.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
