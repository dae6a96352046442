"""Rule verdicts of whole tables: the text is built once per row, and the rules run once per row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.rules import listed, log_type_of, rule_confidence, rule_number
from ..functions.text import rule_text
from ..plans.rulebook import CRITICAL_TYPES, NORMAL_CONFIDENCE, NORMAL_TYPE, RULES, WEIGHTS
from .bind import bind


def _with_text(df: DataFrame, template: str, content: str) -> DataFrame:
    return bind(df, {"_text": rule_text(F.col(template), F.col(content))})


def classify(df: DataFrame, out: str = "verdict", template: str = "event_template", content: str = "content",
             rules: Mapping[str, Sequence[str]] = RULES, weights: Mapping[str, float] = WEIGHTS,
             critical: Sequence[str] = CRITICAL_TYPES) -> DataFrame:
    """Add the struct of log_type, confidence, matched_pattern and is_critical: the first rule that hits."""
    df = bind(_with_text(df, template, content), {"_rule": rule_number(F.col("_text"), rules)})
    of_rule = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("_rule"))
    pairs = listed(rules)
    sure = rule_confidence(F.col("_text"), F.col("_rule"), rules, weights)
    found = F.col("_rule").isNotNull()
    fields = F.struct(F.coalesce(of_rule([c for c, _ in pairs]), F.lit(NORMAL_TYPE)).alias("log_type"),
                      F.when(found, sure).otherwise(NORMAL_CONFIDENCE).alias("confidence"),
                      of_rule([p for _, p in pairs]).alias("matched_pattern"),
                      F.coalesce(of_rule([c in critical for c, _ in pairs]), F.lit(False)).alias("is_critical"))
    return bind(df, {out: fields}).drop("_text", "_rule")


def with_log_type(df: DataFrame, out: str = "log_type", template: str = "event_template", content: str = "content",
                  rules: Mapping[str, Sequence[str]] = RULES) -> DataFrame:
    """Add only the category."""
    return bind(_with_text(df, template, content), {out: log_type_of(F.col("_text"), rules)}).drop("_text")
