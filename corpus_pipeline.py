"""The corpus pipeline: documents in, packed training sequences out.

Each stage works on all documents that its predecessor kept and applies one operator's decisions;
``run`` writes a stage's result to the shared folder and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm import decontaminate, neardup, packing, quality, secrets
from colloquy.llm.queries import table, tokenizer_path
from colloquy.llm.scratch import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose perplexity is outside the limits of their language."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that of the least id."""
    return neardup.keep_one(docs, percent=85)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets; every document stays."""
    return secrets.mask(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 1024 tokens."""
    return packing.pack(docs, tokenizer_path(), end_id=2)


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicate removal", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret masking", secrets_stage),
    ("best-fit packing", packing_stage),
]

#: Tokenization and the language model have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the packed pieces."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
