"""One query per operator over its whole table, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from ..workspace import Workspace
from . import alignment, chat, credentials, fingerprint, jaccard, lines, packing, periods, pieces, quality, substrings, toxicity, wavelet
from .common import read

def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


Query = Callable[[SparkSession, str], DataFrame]


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.query(read(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.query(read(spark, sf_dir, "documents"), Workspace(spark))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.query(read(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    ship(spark)
    return pieces.query(read(spark, sf_dir, "documents"), model or vocabulary("piece_bpe_32k.model"))


def op5_token_id_output(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return wavelet.query(read(spark, sf_dir, "documents"), tokenizer or vocabulary("byte_bpe_50k.json"), Workspace(spark))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return packing.query(read(spark, sf_dir, "documents"), tokenizer or vocabulary("word_bpe_49k.json"), Workspace(spark))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.query(read(spark, sf_dir, "conversations"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.query(read(spark, sf_dir, "documents"), Workspace(spark))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.query(read(spark, sf_dir, "documents"), Workspace(spark))


def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.query(read(spark, sf_dir, "documents"), Workspace(spark))


def op12_periodic_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return periods.query(read(spark, sf_dir, "documents"))


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str, byte_bpe: str | None = None, piece_bpe: str | None = None) -> DataFrame:
    return alignment.query(read(spark, sf_dir, "documents"), byte_bpe or vocabulary("byte_bpe_50k.json"),
                           piece_bpe or vocabulary("piece_bpe_32k.model"), Workspace(spark))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_document_fingerprints, op2_line_dedup, op3_quality_rules, op4_sentencepiece, op5_token_id_output,
    op6_best_fit_packing, op7_toxicity, op8_chat_formatting,
    op9_suffix_array_dedup, op10_ngram_jaccard_join,
    op11_secret_scans, op12_periodic_run_detection, op13_cross_tokenizer_alignment)}
ORACLES: dict[str, str] = {
    "op1_document_fingerprints": fingerprint.SQL, "op2_line_dedup": lines.SQL,
    "op3_quality_rules": quality.SQL, "op8_chat_formatting": chat.SQL,
    "op10_ngram_jaccard_join": jaccard.SQL}
