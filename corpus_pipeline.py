"""The corpus pipeline: language, quality rules, near duplicates, mixture, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; ``run``
writes each result as Parquet and reads it again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import language_id, mixing, near_dedup, packing, quality_rules
from seqloom.llm.common import DOCUMENT_COLUMNS, Scratch, table
from seqloom.session import dealt


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are mostly of one language stay."""
    return language_id.keep_identified(docs).select(*DOCUMENT_COLUMNS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that lose too much or fail the base rules."""
    return quality_rules.clean(docs).select(*DOCUMENT_COLUMNS)


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_dedup.one_of_each(docs).select(*DOCUMENT_COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as its source's target takes, none included."""
    return mixing.remix(docs).select(*DOCUMENT_COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [("languages", languages), ("rules", rules), ("duplicates", duplicates), ("mixture", mixture), ("packed", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = dealt(table(spark, sf_dir, "documents"))
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs


#: learned and hashed stages have no SQL; tests hold run() against a brute-force version
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
