"""Checks and profiles of a parsed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import has
from ..plans.rulebook import BENEFICIAL_COLUMNS, CONTENT_FLAGS, RECOMMENDED_COLUMNS, REQUIRED_COLUMNS


def validate_columns(df: DataFrame) -> DataFrame:
    """One row: which expected columns are there, and whether detection can run on the table."""
    have = {c.lower() for c in df.columns}
    missing = [c for c in REQUIRED_COLUMNS if c not in have]
    recommended = [c for c in RECOMMENDED_COLUMNS if c in have]
    beneficial = [c for c in BENEFICIAL_COLUMNS if c in have]
    return df.agg(F.count(F.lit(1)).alias("total_entries"),
                  F.lit(not missing).alias("valid"),
                  F.lit(",".join(missing)).alias("missing_required"),
                  F.lit(",".join(recommended)).alias("available_recommended"),
                  F.lit(",".join(beneficial)).alias("available_beneficial"),
                  F.lit(not missing and len(recommended) >= 2).alias("ready"))


def quality_issues(df: DataFrame) -> DataFrame:
    """One row of counts with the list of issues they raise."""
    row = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_template").isNull()).alias("empty_templates"),
                 F.count_distinct("event_id").alias("unique_events"), F.count_if(F.col("content").isNull()).alias("empty_content"))
    issues = F.filter(F.array(
        F.when(F.col("empty_templates") > 0, "empty templates"),
        F.when(F.col("unique_events") < F.col("total") * 0.1, "low template diversity"),
        F.when(F.col("empty_content") > F.col("total") * 0.5, "high empty content ratio")), lambda i: i.isNotNull())
    return row.withColumn("issues", issues)


def parsing_stats(df: DataFrame) -> DataFrame:
    """One row: totals, distinct templates and components, rows per level, date range, content lengths."""
    # Rows are counted per combination first; totals, distinct values and levels come from those.
    length = F.length("content").cast("long")
    kinds = df.groupBy("event_template", "component", "level").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"),
        F.sum(length).alias("chars"), F.count("content").alias("filled"), F.max(length).alias("longest"))
    levels = kinds.filter(F.col("level").isNotNull()).groupBy("level").agg(F.sum("n").alias("n")).agg(
        F.sort_array(F.collect_list(F.struct("level", "n"))).alias("levels"))
    stats = kinds.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("total_logs"),
                      F.count_distinct("event_template").alias("unique_templates"),
                      F.count_distinct("component").alias("unique_components"), F.min("first").alias("first_date"),
                      F.max("last").alias("last_date"), F.try_divide(F.sum("chars"), F.sum("filled")).alias("avg_length"),
                      F.max("longest").alias("max_length"))
    key = F.lit(1).alias("_k")
    return stats.select(key, "*").join(levels.select(key, F.map_from_entries("levels").alias("log_levels")), "_k").drop("_k")


def feature_prevalence(df: DataFrame) -> DataFrame:
    """(feature, pct): share of logs with each content flag, in percent."""
    row = df.agg(*[(F.avg(has(F.col("content"), p)) * 100).alias(name) for name, p in CONTENT_FLAGS.items()])
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("pct")) for n in CONTENT_FLAGS])))


def cardinality_gate(df: DataFrame, column: str, limit: int = 1000) -> DataFrame:
    """One row: distinct values, and whether the column may serve as a feature."""
    return df.agg(F.count_distinct(column).alias("distinct_values")).withColumn("keep", F.col("distinct_values") < limit)


def passes_gate(df: DataFrame, column: str, limit: int = 1000) -> bool:
    return bool(cardinality_gate(df, column, limit).first().keep)
