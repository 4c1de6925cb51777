"""Corpus pipeline: from raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontaminate, packing, quality_rules, secret_scan, simhash_dedup
from weftline.llm._shared import stored
from weftline.llm.queries import tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents by the quality rules, and cut lines over the limit from the others.

    Null and empty texts have too few words and go. Null ids, ties and repeated rows
    are judged like others; columns keep their names.
    """
    return quality_rules.apply_quality_rules(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts stays whose five-word shingles are 0.8 alike or more: that with the smallest id.

    Null and empty texts are groups of their own; rows without an id stay; of rows
    that repeat an id one stays.
    """
    return simhash_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of benchmark items from the texts; documents that are little else go.

    Null and empty texts, and all texts against an empty benchmark, stay as they are.
    """
    return decontaminate.remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; null and empty texts stay as they are, and no row goes."""
    return secret_scan.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences; a null or empty text has its end token only."""
    return packing.pack_documents(docs, tokenizer_file())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("near-duplicate removal", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scan", secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is written and read again. Empty tables give an empty table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can state neither the tokenizer's ids nor the packing; tests hold each stage against a plain version.
ORACLE_SQL = None
