"""The registered queries: one per operator, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import dealt
from . import byte_cnn, language_id, licenses, mixing, quality_rules, topk, toxicity, urls
from .common import fold, table
from .near_dedup import near_duplicates
from .packing import pack


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """All documents, for work that outweighs dealing a small table to all cores."""
    return dealt(table(spark, sf_dir, "documents").select(*columns or "*"))


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir, "doc_id", "text")
    found = toxicity.score(documents, toxicity.learn(documents, table(spark, sf_dir, "labels")))
    score = F.col("toxic_score")
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), F.size("toxic_spans").alias("n_spans"), F.to_json("toxic_spans").alias("spans"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir, "doc_id", "text", "lang")
    found = language_id.identify(documents.drop("lang"), language_id.learn(documents), keep_text=False)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op5_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir, "doc_id", "text")
    found = byte_cnn.score(documents, byte_cnn.learn(documents, table(spark, sf_dir, "labels")))
    score = F.col("quality_score")
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(_documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_license_scans, op2_packing, op3_toxicity, op4_language_id, op5_quality_cnn, op6_minhash, op7_mixing, op8_quality_rules, op9_url_filters, op10_top_k)}
ORACLES: dict[str, str] = {"op1_license_scans": licenses.oracle(), "op8_quality_rules": quality_rules.oracle(), "op10_top_k": topk.ORACLE}
