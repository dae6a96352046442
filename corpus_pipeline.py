"""A corpus made ready for training, as five stages over ``documents``.

Each stage works on all that the one before it kept. What it decides takes effect: rejected
documents, dropped lines, near duplicates and repeated strings are gone for the next stage. All
stages but the last return the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberlog.llm import jaccard, lines, packing, quality, substrings
from emberlog.llm.queries import vocabulary
from emberlog.workspace import Workspace

# Packing, which SQL cannot express, ends the pipeline; tests/llm holds it against brute force.
ORACLE_SQL = None


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the input, in its order, with the length of the text as it is now."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long"))
    return docs.select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go."""
    return quality.stage(docs).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents stay in one of them."""
    return _counted(lines.stage(docs, Workspace(spark)), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the document with the least id stays."""
    return jaccard.stage(docs, Workspace(spark)).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that began earlier in the corpus are cut out."""
    return _counted(substrings.stage(docs, Workspace(spark)), docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece of a document."""
    return packing.query(docs, vocabulary("word_bpe_49k.json"), Workspace(spark))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row; what one hands to the next is written to the shared folder."""
    ws = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = ws.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
