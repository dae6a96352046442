"""Training data without known anomalies, and what was removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rules import any_hits, hits, listed
from ..functions.text import word_count
from ..plans.rulebook import CLEANING_PATTERNS, ERROR_LEVELS, PROBLEM_COMPONENTS
from ..workspace import Workspace
from .bind import bind

# Stages in order; a row falls at the first that drops it.
STAGES = ("level", "content", "component", "length", "words", "keys")


def is_error_level(level: Column) -> Column:
    return F.coalesce(level.isin(*ERROR_LEVELS), F.lit(False))


def cleaning_text(content: Column, template: Column) -> Column:
    blank = F.lit("")
    return F.lower(F.concat(F.coalesce(content, blank), F.lit(" "), F.coalesce(template, blank)))


def is_anomalous(text: Column) -> Column:
    """Whether any cleaning pattern hits the lower-cased text."""
    return any_hits(text, [p for _, p in listed(CLEANING_PATTERNS)])


def is_problem_component(component: Column) -> Column:
    name, hit = F.lower(component), F.lit(False)
    for part in PROBLEM_COMPONENTS:
        hit = hit | F.contains(name, F.lit(part))
    return F.coalesce(hit, F.lit(False))


def filter_error_levels(df: DataFrame) -> DataFrame:
    return df.filter(~is_error_level(F.col("level")))


def filter_anomalous_content(df: DataFrame) -> DataFrame:
    text = bind(df, {"_text": cleaning_text(F.col("content"), F.col("event_template"))})
    return text.filter(~is_anomalous(F.col("_text"))).drop("_text")


def filter_components(df: DataFrame) -> DataFrame:
    return df.filter(~is_problem_component(F.col("component")))


def drop_null_keys(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["event_template", "event_id"])


def _bounds(df: DataFrame, measure: Column) -> tuple[float, float] | None:
    mean, std = df.agg(F.avg(measure), F.stddev_samp(measure)).first()
    return None if mean is None or std is None else (mean - 3 * std, mean + 3 * std)


def _within(measure: Column, bounds: tuple[float, float] | None) -> Column:
    """Without bounds (fewer than two rows) nothing is within."""
    return F.lit(False) if bounds is None else F.coalesce(measure.between(*bounds), F.lit(False))


def outlier_tests(df: DataFrame) -> tuple[Column, Column]:
    """Tests for content length, then word count: three deviations, the second among survivors of the first."""
    length, count = F.length("content"), word_count(F.col("content"))
    long_enough = _within(length, _bounds(df, length))
    return long_enough, _within(count, _bounds(df.filter(long_enough), count))


def drop_outliers(df: DataFrame) -> DataFrame:
    length, count = outlier_tests(df)
    return df.filter(length & count)


def with_stage(df: DataFrame, ws: Workspace, aggressive: bool = True) -> DataFrame:
    """Add ``dropped_at``: the stage at which the row falls, null if it stays.

    The patterns run once per row; the outlier bounds come from two aggregates over the staged rows.
    """
    text = bind(df, {"_text": cleaning_text(F.col("content"), F.col("event_template"))})
    early = (F.when(is_error_level(F.col("level")), "level").when(is_anomalous(F.col("_text")), "content")
             .when(is_problem_component(F.col("component")), "component"))
    rows = ws.stage(text.withColumn("_early", early).drop("_text"), "cleaning")
    late = F.col("_early")
    if aggressive:
        length, count = outlier_tests(rows.filter(late.isNull()))
        late = F.when(late.isNotNull(), late).when(~length, "length").when(~count, "words")
    no_key = F.col("event_template").isNull() | F.col("event_id").isNull()
    return rows.withColumn("dropped_at", F.coalesce(late, F.when(no_key, "keys"))).drop("_early")


def clean_training_data(df: DataFrame, ws: Workspace, aggressive: bool = True) -> DataFrame:
    return with_stage(df, ws, aggressive).filter("dropped_at is null").drop("dropped_at")


def cleaning_funnel(staged: DataFrame) -> DataFrame:
    """Rows left after each stage, rows removed so far and their share: one pass over the rows."""
    counts = staged.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("dropped_at") == s).alias(s) for s in STAGES])
    entries, gone = [], F.lit(0)
    for position, stage in enumerate(STAGES):
        gone = gone + F.col(stage)
        entries.append(F.struct(F.lit(position).alias("position"), F.lit(stage).alias("stage"),
                                (F.col("total") - gone).alias("left"), gone.cast("long").alias("removed"),
                                F.coalesce(F.try_divide(100.0 * gone, F.col("total")), F.lit(0.0)).alias("removed_pct")))
    return counts.select(F.inline(F.array(*entries)))


def pattern_hits(df: DataFrame) -> DataFrame:
    """Rows hit by each cleaning pattern, counted independently after the level filter."""
    text = bind(filter_error_levels(df), {"_text": cleaning_text(F.col("content"), F.col("event_template"))})
    names = listed(CLEANING_PATTERNS)
    counts = text.filter(is_anomalous(F.col("_text"))).agg(
        *[F.count_if(hits(F.col("_text"), p)).alias(f"p{i}") for i, (_, p) in enumerate(names)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("category"), F.lit(p).alias("pattern"),
                                                     F.col(f"p{i}").alias("hits")) for i, (c, p) in enumerate(names)])))


def removed_rows(original: DataFrame, clean: DataFrame, key: str = "line_id") -> DataFrame:
    return original.join(clean.select(key), key, "left_anti")


def removed_profile(removed: DataFrame, key: str = "line_id", components: int = 10, samples: int = 5,
                    cut: int = 80) -> DataFrame:
    """(kind, name, n): removed rows by level, the top components, and the first removed contents."""
    count = F.count(F.lit(1)).alias("n")
    levels = removed.groupBy(F.lit("level").alias("kind"), F.col("level").alias("name")).agg(count)
    top = (removed.groupBy(F.lit("component").alias("kind"), F.col("component").alias("name")).agg(count)
           .orderBy(F.desc("n"), "name").limit(components))
    first = (removed.orderBy(key).limit(samples)
             .select(F.lit("sample").alias("kind"), F.substring("content", 1, cut).alias("name"), F.lit(1).cast("long").alias("n")))
    return levels.unionByName(top).unionByName(first)


def cleaning_report(staged: DataFrame, aggressive: bool = True) -> DataFrame:
    """One row: original, clean and removed rows, and the removed share."""
    total, clean = F.count(F.lit(1)), F.count_if(F.col("dropped_at").isNull())
    return staged.agg(total.alias("original"), clean.alias("clean"), (total - clean).alias("removed"),
                      F.coalesce(F.round(F.try_divide(100.0 * (total - clean), total), 1), F.lit(0.0)).alias("removed_pct"),
                      F.lit(aggressive).alias("aggressive"))
