"""Flag windows, label their logs, and describe the run."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.severity import severity, severity_confidence
from ..plans.rulebook import (ALERT_LIMITS, FLAG_PERCENTILE, NORMAL_TYPE, SEVERITY_PERCENTILES, WINDOW_LENGTH,
                              WINDOW_STRIDE)
from ..workspace import Workspace, sized_like
from .classify import with_log_type
from .indexing import percentile_values
from .prune import join_few
from .windows import PLACE, sequence_windows, window_error

MODES = ("sequential", "single_log")
ALL_MODES = (*MODES, "hybrid")
# Share of each path in the blended error.
HYBRID_WEIGHTS = {"sequential": 0.6, "single_log": 0.4}


def hybrid_error(sequential: Column, single: Column) -> Column:
    return HYBRID_WEIGHTS["sequential"] * sequential + HYBRID_WEIGHTS["single_log"] * single


def flag_threshold(errors: DataFrame, error: str, ws: Workspace, percentile: float = FLAG_PERCENTILE) -> float | None:
    """The percentile of the batch's own errors; None if there are none."""
    values = percentile_values(errors, error, [percentile / 100], ws)
    return values[0] if values else None


def flag_windows(errors: DataFrame, error: str, threshold: float | None) -> DataFrame:
    """Windows whose error is above the threshold (strictly)."""
    return errors.filter(F.lit(False) if threshold is None else F.col(error) > threshold)


@dataclass
class SeverityModel:
    """Learned thresholds and the statistics of the errors they come from."""

    thresholds: list[float]
    percentiles: tuple[int, ...] = SEVERITY_PERCENTILES
    stats: dict[str, float] = field(default_factory=dict)

    @classmethod
    def fit(cls, errors: DataFrame, error: str, ws: Workspace,
            percentiles: tuple[int, ...] = SEVERITY_PERCENTILES) -> "SeverityModel":
        points = [p / 100 for p in percentiles] + [0.25, 0.5, 0.75]
        values = percentile_values(errors, error, points, ws)
        if not values:
            raise ValueError("no errors to learn severity thresholds from")
        q25, median, q75 = values[-3:]
        mean, std = errors.agg(F.avg(error), F.stddev_pop(error)).first()
        return cls(values[:-3], tuple(percentiles), {"mean": mean, "std": std, "median": median, "iqr": q75 - q25})

    def label(self, error: Column) -> Column:
        return severity(error, self.thresholds)

    def confidence(self, error: Column) -> Column:
        return severity_confidence(error, self.thresholds)

    def to_row(self, spark) -> DataFrame:
        names = [f"p{p}" for p in self.percentiles]
        return spark.createDataFrame([(*self.thresholds, *self.stats.values())],
                                     ", ".join(f"{n} double" for n in [*names, *self.stats]))


def join_window_logs(windows: DataFrame, flagged: DataFrame, error: str) -> DataFrame:
    """The logs of flagged windows with the window's error; logs of other windows go before any shuffle."""
    return join_few(windows, sized_like(flagged.select("win_id", F.col(error).alias("anomaly_score")), flagged), "win_id")


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def _typed(rows: DataFrame) -> DataFrame:
    """Rules run only on the logs of flagged windows, once per log."""
    return with_log_type(rows, "anomaly_type")


def single_log_anomalies(windows: DataFrame, flagged: DataFrame, error: str, model: SeverityModel) -> DataFrame:
    """Logs of flagged windows that some rule hits, with their window's error and severity."""
    return _single(_typed(join_window_logs(windows, flagged, error)), model)


def _single(rows: DataFrame, model: SeverityModel, key: str | None = None) -> DataFrame:
    rows = rows.filter(F.col("anomaly_type") != NORMAL_TYPE)
    score = F.col("anomaly_score")
    log = F.struct(*[_text(c) for c in ("content", "event_template", "level", "component", "line_id")])
    return rows.select(*([key] if key else []), log.alias("log"), "anomaly_type", model.label(score).alias("severity"),
                       model.confidence(score).alias("confidence"), _text("time").alias("timestamp"), "anomaly_score",
                       F.lit("single_log").alias("processing_mode"), "win_id", F.col("idx").alias("position"))


def _dominant(types: Column) -> Column:
    """Most common value of an array; ties go to the one that occurs first."""
    ranked = F.transform(F.array_distinct(types), lambda t: F.struct(
        (F.size(types) - F.size(F.array_remove(types, t))).alias("n"),
        (-F.array_position(types, t)).alias("earliest"), t.alias("type")))
    return F.array_max(ranked)["type"]


def sequential_anomalies(windows: DataFrame, flagged: DataFrame, error: str, model: SeverityModel,
                         mode: str = "sequential") -> DataFrame:
    """Flagged windows with at least one log that some rule hits, with all their logs in order."""
    return _sequences(_typed(join_window_logs(windows, flagged, error)), model, mode)


def _sequences(rows: DataFrame, model: SeverityModel, mode: str, key: str | None = None) -> DataFrame:
    keys = [key] if key else []
    log = F.struct(*[_text(c) for c in ("content", "event_template", "level", "component", "line_id")],
                   _text("time").alias("timestamp"))
    entry = F.struct("offset", log.alias("log"), F.col("anomaly_type").alias("type"))
    grouped = (rows.groupBy("win_id", "start_idx", "anomaly_score")
               .agg(F.sort_array(F.collect_list(entry)).alias("entries"), *[F.first(c).alias(c) for c in keys])
               .withColumn("types", F.filter("entries.type", lambda t: t != NORMAL_TYPE))
               .filter(F.size("types") > 0))
    score = F.col("anomaly_score")
    return grouped.select(
        *keys, F.col("entries.log").alias("logs"), _dominant(F.col("types")).alias("anomaly_type"),
        model.label(score).alias("severity"), model.confidence(score).alias("confidence"),
        F.get("entries", F.lit(0))["log"]["timestamp"].alias("timestamp"), F.size("entries").alias("sequence_length"),
        "anomaly_score", F.lit(mode).alias("processing_mode"), F.size("types").alias("non_normal_count"),
        F.size("entries").alias("total_logs_in_sequence"), "win_id", F.col("start_idx").alias("position"))


@dataclass
class Detection:
    """Outcome of a run: anomalies per mode (lazy), thresholds, severity model, number of logs."""

    total_logs: int
    mode: str
    thresholds: dict[str, float | None]
    severity: SeverityModel
    errors: DataFrame
    single: DataFrame | None = None
    sequential: DataFrame | None = None
    hybrid: DataFrame | None = None

    def anomalies(self) -> DataFrame:
        """All modes of the run in one table (union all)."""
        return union_modes(*[a for a in (self.single, self.sequential, self.hybrid) if a is not None])

    def summary(self) -> DataFrame:
        """One row: logs, anomalies and thresholds per mode."""
        counts = self.anomalies().agg(
            F.lit(self.total_logs).cast("long").alias("total_logs"), F.lit(self.mode).alias("mode"),
            *[F.count_if(F.col("processing_mode") == m).alias(f"{m}_count") for m in ALL_MODES])
        limits = [F.lit(self.thresholds.get(m)).cast("double").alias(f"{m}_threshold") for m in ALL_MODES]
        return counts.select("*", *limits)


LOG_COLUMNS = ("line_id", "time", "level", "component", "content", "event_template")


def with_log_columns(rows: DataFrame) -> DataFrame:
    """Columns that a layout lacks are added as null."""
    have = {c.lower() for c in rows.columns}
    return rows.withColumns({c: F.lit(None).cast("string") for c in LOG_COLUMNS if c not in have})


def detect(rows: DataFrame, n: int | Column, ws: Workspace, mode: str = "both", sequential_error: str = "sequential_error",
           single_error: str = "single_error", model: SeverityModel | None = None,
           seq_len: int = WINDOW_LENGTH, stride: int = WINDOW_STRIDE, key: str | None = None) -> Detection:
    """Detect from one error per row and mode: a window's error is the mean of its rows.

    With ``key``, rows are those of ``place_rows`` with that key, and no window mixes keys.
    """
    windows = sequence_windows(rows, n, seq_len, stride, place=PLACE if key else None)
    errors = ws.stage(window_error(windows, sequential_error, single_error)
                      .select("win_id", F.col(sequential_error).alias("sequential_error"),
                              F.col(single_error).alias("single_error")), "window_errors")
    return detect_windows(rows, n, errors, ws, mode, model, seq_len, stride, key)


def detect_windows(rows: DataFrame, n: int | Column, errors: DataFrame, ws: Workspace, mode: str = "both",
                   model: SeverityModel | None = None, seq_len: int = WINDOW_LENGTH,
                   stride: int = WINDOW_STRIDE, key: str | None = None) -> Detection:
    """Flag the top errors of the batch, and label what their windows hold.

    Mode ``hybrid`` blends both errors of a window into one and labels its logs as a sequence.

    ``rows`` have idx and the log columns, with ``key`` also those of ``place_rows``; ``errors`` (staged)
    has win_id, sequential_error and single_error. Without a ``model`` the severity thresholds are
    learned from this batch. The flags of all modes are one table: the logs are read once, those of
    windows without a flag go before any shuffle, and rules look at what is left once.
    """
    if mode not in ("both", "sequential", "single", "hybrid"):
        raise ValueError(f"unknown mode {mode!r}")
    windows = sequence_windows(with_log_columns(rows), n, seq_len, stride, place=PLACE if key else None)
    if model is None:
        both = errors.select(F.explode(F.array("sequential_error", "single_error")).alias("error"))
        model = SeverityModel.fit(both, "error", ws)
    scores = {"single_log": F.col("single_error"), "sequential": F.col("sequential_error")}
    if mode == "hybrid":
        scores = {"hybrid": hybrid_error(F.col("sequential_error"), F.col("single_error"))}
    elif mode != "both":
        scores = {m: e for m, e in scores.items() if m.startswith(mode)}
    scored = errors.select("win_id", *[e.alias(m) for m, e in scores.items()])
    found = Detection(total_rows(rows, n), mode, {m: flag_threshold(scored, m, ws) for m in scores}, model, errors)
    over = {m: F.when(F.lit(False) if limit is None else F.col(m) > limit, F.col(m)).alias(m) for m, limit in found.thresholds.items()}
    flags = scored.select("win_id", *over.values()).filter(F.coalesce(*scores).isNotNull())
    held = ws.stage(_typed(join_few(windows, ws.stage(flags, "flags", measure=True), "win_id")), "flagged_logs")
    part = lambda m: held.filter(F.col(m).isNotNull()).withColumnRenamed(m, "anomaly_score")
    if "single_log" in scores:
        found.single = _single(part("single_log"), model, key)
    if "sequential" in scores:
        found.sequential = _sequences(part("sequential"), model, "sequential", key)
    if "hybrid" in scores:
        found.hybrid = _sequences(part("hybrid"), model, "hybrid", key)
    return found


def total_rows(rows: DataFrame, n: int | Column) -> int:
    return n if isinstance(n, int) else rows.count()


def union_modes(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def export_records(anomalies: DataFrame) -> DataFrame:
    """One flat record per anomaly; a sequence is represented by its first log."""
    log_fields = ("content", "event_template", "level", "component", "line_id")
    first = F.get("logs", F.lit(0))
    log = F.struct(*[F.coalesce(F.col(f"log.{f}"), first[f]).alias(f) for f in log_fields])
    return anomalies.withColumn("log", log).select(
        "log", "anomaly_type", "severity", "confidence", "anomaly_score", "processing_mode", "timestamp")


def ensemble(errors: DataFrame, weights: DataFrame, key: str = "win_id") -> DataFrame:
    """Weighted mean of the models' errors. ``weights`` has one row per model."""
    joined = errors.join(F.broadcast(weights), "model_id")
    return joined.groupBy(key).agg((F.sum(F.col("w") * F.col("err")) / F.sum("w")).alias("err"))


def ensemble_weights(losses: DataFrame) -> DataFrame:
    """Weights in proportion to 1/loss that add up to one; one row per model.

    Models without any loss share the whole weight.
    """
    perfect = losses.filter("loss = 0").count()
    if perfect:
        return losses.select("model_id", F.when(F.col("loss") == 0, F.lit(1.0 / perfect)).otherwise(0.0).alias("w"))
    total = losses.agg(F.sum(1 / F.col("loss"))).first()[0]
    return losses.select("model_id", (1 / F.col("loss") / F.lit(total)).alias("w"))


def threat_level(anomalies: DataFrame) -> DataFrame:
    critical, high = (F.count_if(F.col("severity") == s) for s in ("Critical", "High"))
    level = F.when(critical > 0, "CRITICAL").when(high > 5, "HIGH").otherwise("NORMAL")
    return anomalies.agg(critical.alias("critical"), high.alias("high"), level.alias("threat_level"))


def alerts(anomalies: DataFrame, total_logs: int, limits: dict[str, float] = ALERT_LIMITS) -> DataFrame:
    """(rule, value, limit, fired): which alert limits the run reaches."""
    mode = lambda m: F.count_if(F.col("processing_mode") == m).cast("double")
    level = lambda s: F.count_if(F.col("severity") == s).cast("double")
    rate = F.count(F.lit(1)) * 100.0 / total_logs if total_logs else F.lit(0.0)
    values = {"critical": level("Critical"), "high": level("High"), "rate": rate, "sequential": mode("sequential"),
              "single_log": mode("single_log"), "hybrid": mode("hybrid")}
    row = anomalies.agg(*[v.alias(k) for k, v in values.items()])
    entries = F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("value"),
                                 F.lit(float(limits[k])).alias("limit")) for k in values])
    return (row.select(F.inline(entries))
            .withColumn("fired", F.col("value") >= F.col("limit")))


def consensus(votes: DataFrame, detectors: list[str], least: int = 2) -> DataFrame:
    """Rows that at least so many detectors call an outlier (-1)."""
    count = sum(((F.col(d) == -1).cast("int") for d in detectors), F.lit(0))
    return votes.withColumn("anomaly_votes", count).filter(F.col("anomaly_votes") >= least)


def count_flagged(predictions: DataFrame, prediction: str = "prediction") -> DataFrame:
    return predictions.agg(F.count_if(F.col(prediction) == -1).alias("anomalies"), F.count(F.lit(1)).alias("total"))
