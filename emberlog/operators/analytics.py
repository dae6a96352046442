"""Aggregations over anomaly tables. Statistics are one row per mode, severity or type."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.rulebook import RULES, SEVERITY_LABELS, WEIGHTS
from ..workspace import Workspace
from .indexing import percentiles

MODES = ("single_log", "sequential")


def _dimension(df: DataFrame, name: str, values: Sequence[str]) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame([(v,) for v in values], f"{name} string"))


def _in_mode(mode: str, condition: Column | None = None) -> Column:
    hit = F.col("processing_mode") == mode
    return F.count_if(hit if condition is None else hit & condition)


def severity_distribution(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("processing_mode", "severity").agg(F.count(F.lit(1)).alias("n"))


def score_statistics(anomalies: DataFrame, ws: Workspace) -> DataFrame:
    """Mean, std, min, max and percentiles of the score per mode; zeros for a mode without anomalies."""
    by, score = "processing_mode", "anomaly_score"
    names = ["median", "p25", "p75", "p90", "p95", "p99"]
    pct = percentiles(anomalies, score, [0.5, 0.25, 0.75, 0.9, 0.95, 0.99], ws, by=[by])
    stats = anomalies.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"),
                                      F.stddev_pop(score).alias("std"), F.min(score).alias("min"), F.max(score).alias("max"))
    pct = pct.select(by, *[F.get("pct", F.lit(i)).alias(n) for i, n in enumerate(names)])
    out = _dimension(anomalies, by, MODES).join(stats, by, "left").join(pct, by, "left")
    return out.select(by, *[F.coalesce(c, F.lit(0)).alias(c) for c in ["n", "mean", "std", "min", "max", *names]])


def threshold_effectiveness(anomalies: DataFrame, ws: Workspace,
                            points: Sequence[int] = (80, 85, 90, 95, 97, 99)) -> DataFrame:
    """For each percentile: its value, how many scores lie above, and their share."""
    row = percentiles(anomalies, "anomaly_score", [p / 100 for p in points], ws).first()
    values = list(row.pct) if row and row.pct is not None else []
    if not values:
        return anomalies.sparkSession.createDataFrame([], "percentile int, threshold double, detected long, rate double")
    above = anomalies.agg(F.count(F.lit(1)).alias("n"),
                          *[F.count_if(F.col("anomaly_score") > v).alias(f"a{p}") for p, v in zip(points, values)])
    entries = [F.struct(F.lit(p).alias("percentile"), F.lit(v).alias("threshold"), F.col(f"a{p}").alias("detected"),
                        (F.col(f"a{p}") / F.col("n")).alias("rate")) for p, v in zip(points, values)]
    return above.select(F.inline(F.array(*entries)))


def severity_transitions(anomalies: DataFrame) -> DataFrame:
    """Per severity: anomalies of either mode, and the difference; zeros filled in."""
    counts = anomalies.groupBy("severity").agg(_in_mode("single_log").alias("single_count"),
                                               _in_mode("sequential").alias("sequential_count"))
    out = _dimension(anomalies, "severity", SEVERITY_LABELS).join(counts, "severity", "left")
    single, seq = (F.coalesce(c, F.lit(0)) for c in ("single_count", "sequential_count"))
    return out.select("severity", single.alias("single_count"), seq.alias("sequential_count"),
                      (seq - single).alias("difference"))


def confidence_by(anomalies: DataFrame, key: str, ws: Workspace) -> DataFrame:
    """Statistics of the confidence per severity or type."""
    stats = anomalies.groupBy(key).agg(
        F.avg("confidence").alias("mean"), F.stddev_pop("confidence").alias("std"), F.min("confidence").alias("min"),
        F.max("confidence").alias("max"), F.count(F.lit(1)).alias("n"))
    median = percentiles(anomalies, "confidence", [0.5], ws, by=[key]).select(key, F.get("pct", F.lit(0)).alias("median"))
    return stats.join(median, key)


def type_distribution(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("anomaly_type").agg(_in_mode("single_log").alias("single"),
                                                 _in_mode("sequential").alias("sequential"),
                                                 F.count(F.lit(1)).alias("combined"))


def pattern_effectiveness(anomalies: DataFrame, rules: Mapping[str, Sequence[str]] = RULES,
                          weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """Every rule category with its patterns, weight and detections per mode."""
    spark = anomalies.sparkSession
    dim = spark.createDataFrame([(c, len(p), weights.get(c, 0.7)) for c, p in rules.items()],
                                "anomaly_type string, pattern_count long, weight double")
    hits = type_distribution(anomalies).select("anomaly_type", "single", "sequential")
    return F.broadcast(dim).join(hits, "anomaly_type", "left").select(
        F.col("anomaly_type").alias("category"), "pattern_count", "weight",
        F.coalesce("single", F.lit(0)).alias("single_detections"),
        F.coalesce("sequential", F.lit(0)).alias("sequential_detections"))


def type_severity_matrix(anomalies: DataFrame) -> DataFrame:
    """Share of each severity within each type. The totals come from the counted table."""
    cells = anomalies.groupBy("anomaly_type", "severity").agg(F.count(F.lit(1)).alias("n"))
    totals = cells.groupBy("anomaly_type").agg(F.sum("n").alias("total"))
    return cells.join(totals, "anomaly_type").select("anomaly_type", "severity", (F.col("n") / F.col("total")).alias("share"))


def high_critical_share(anomalies: DataFrame) -> DataFrame:
    serious = F.col("severity").isin("High", "Critical").cast("double")
    return anomalies.groupBy("anomaly_type").agg((F.avg(serious) * 100).alias("high_critical_pct"))


def classification_metrics(labeled: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, from one confusion table."""
    cells = labeled.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(F.inline(F.array(
        F.struct(F.col("t").alias("class"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp"),
                 F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("tp"),
                 F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")))))
    sums = sides.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"),
                                      F.sum("predicted").alias("predicted"))
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide("tp", "predicted"), zero)
    recall = F.coalesce(F.try_divide("tp", "support"), zero)
    scored = sums.select("class", precision.alias("precision"), recall.alias("recall"), "support")
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero)
    return scored.withColumn("f1", f1)


def score_stability(anomalies: DataFrame) -> DataFrame:
    return anomalies.agg(F.var_pop("confidence").alias("confidence_variance"),
                         F.stddev_pop("anomaly_score").alias("score_std"))


def top_types(anomalies: DataFrame, n: int = 5) -> DataFrame:
    return (anomalies.groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "anomaly_type").limit(n))


def severity_summary(anomalies: DataFrame, thresholds: Mapping[str, float]) -> DataFrame:
    """One row: anomalies per mode and severity, learned thresholds, mean score per mode, overall std."""
    counts = [_in_mode(m, F.col("severity") == s).alias(f"{m}_{s.lower()}") for m in MODES for s in SEVERITY_LABELS]
    means = [F.avg(F.when(F.col("processing_mode") == m, F.col("anomaly_score"))).alias(f"{m}_mean") for m in MODES]
    limits = [F.lit(float(v)).alias(name) for name, v in thresholds.items()]
    return anomalies.agg(*counts, *means, F.stddev_pop("anomaly_score").alias("combined_std")).select("*", *limits)


def mode_error_summary(anomalies: DataFrame, errors: DataFrame, thresholds: Mapping[str, float | None],
                       columns: Mapping[str, str]) -> DataFrame:
    """Per mode: anomalies, mean window error, threshold. ``columns`` names each mode's error column."""
    spark = anomalies.sparkSession
    counts = anomalies.groupBy("processing_mode").agg(F.count(F.lit(1)).alias("n"))
    means = errors.agg(*[F.avg(c).alias(m) for m, c in columns.items()])
    per_mode = means.select(F.inline(F.array(*[F.struct(
        F.lit(m).alias("processing_mode"), F.col(m).alias("mean_error"),
        F.lit(thresholds.get(m)).cast("double").alias("threshold")) for m in columns])))
    return per_mode.join(counts, "processing_mode", "left").select(
        "processing_mode", F.coalesce("n", F.lit(0)).alias("total_anomalies"), "mean_error", "threshold")


def hourly_profile(anomalies: DataFrame, ts: str = "ts") -> DataFrame:
    """Anomalies per hour of day, and how many of them fall on a weekend."""
    weekend = F.dayofweek(ts).isin(1, 7)
    return anomalies.groupBy(F.hour(ts).cast("long").alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(weekend).alias("weekend"), F.count_if(~weekend).alias("weekday"))


def mode_overlap(anomalies: DataFrame) -> DataFrame:
    """Logs found by both modes or one, and whether severity rises, falls or stays between them."""
    rank = lambda c: F.array_position(F.array(*[F.lit(s) for s in SEVERITY_LABELS]), c)
    # A log may lie in several flagged windows: it counts once per mode, at its highest severity.
    once = lambda df, name: df.groupBy("line_id").agg(F.max(rank(F.col("severity"))).alias(name))
    single = once(anomalies.filter(F.col("processing_mode") == "single_log")
                  .select(F.col("log.line_id").alias("line_id"), "severity"), "single")
    seq = once(anomalies.filter(F.col("processing_mode") == "sequential")
               .select(F.explode("logs.line_id").alias("line_id"), "severity"), "sequential")
    both = single.join(seq, "line_id", "full_outer")
    s, q = F.col("single"), F.col("sequential")
    return both.agg(F.count_if(s.isNotNull() & q.isNotNull()).alias("both"),
                    F.count_if(q.isNull()).alias("single_only"), F.count_if(s.isNull()).alias("sequential_only"),
                    F.count_if(q > s).alias("escalated"), F.count_if(q < s).alias("reduced"),
                    F.count_if(q == s).alias("consistent"))
