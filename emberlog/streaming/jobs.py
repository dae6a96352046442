"""Streaming jobs: the batch expressions on a stream, and sinks that may safely repeat a batch.

Every batch is written to a folder named by its number. A batch that is run again after a failure
overwrites its own folder, so each record is kept exactly once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import collect
from ..operators.dashboard import threat_type_counts
from ..operators.lookup import lookup_join
from ..sources.sinks import export_batch, store_entries
from .levels import BATCH, Levels

Batch = Callable[[DataFrame, int], None]


def batch_folder(path: str, number: int) -> str:
    return f"{path}/batch_id={number}"


def write_batch(df: DataFrame, path: str, number: int) -> None:
    df.write.mode("overwrite").parquet(batch_folder(path, number))


def each_batch(stream: DataFrame, run: Batch, checkpoint: str, mode: str = "append") -> DataStreamWriter:
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(run)


def stream_parse(stream: DataFrame, path: str, checkpoint: str, value: str = "value") -> DataStreamWriter:
    """Collected payloads to canonical lines; noise and empty records are left out."""
    lines = collect.route(stream, value).filter(F.col("output").isNotNull()).select("route", "output")
    return each_batch(lines, lambda df, number: write_batch(df, path, number), checkpoint)


def stream_route(stream: DataFrame, path: str, dead_letters: str, checkpoint: str, value: str = "value") -> DataStreamWriter:
    """Good lines to one table, unrecognized and invalid payloads to another."""
    routed = collect.route(stream, value).select(value, "route", "output")

    def run(df: DataFrame, number: int) -> None:
        df = df.persist()
        bad = F.col("route").isin("unrecognized", "invalid")
        write_batch(df.filter(~bad & F.col("output").isNotNull()).select("route", "output"), path, number)
        write_batch(df.filter(bad).select("route", value), dead_letters, number)
        df.unpersist()

    return each_batch(routed, run, checkpoint)


def stream_alert(stream: DataFrame, thresholds: DataFrame, on: list[str], score: str) -> DataFrame:
    """Records whose score is above their key's threshold: a stream-static look-up join."""
    return lookup_join(stream, thresholds, on).filter(F.col(score) > F.col("threshold"))


def stream_fanout(stream: DataFrame, sinks: Mapping[str, Callable[[DataFrame, int], None]], checkpoint: str,
                  now: Column | None = None, attempts: int = 3) -> DataStreamWriter:
    """Each stored anomaly to every viewer; a failing viewer is tried again."""

    def run(df: DataFrame, number: int) -> None:
        stored = store_entries(df, now).persist()
        for write in sinks.values():
            export_batch(stored, lambda rows: write(rows, number), attempts)
        stored.unpersist()

    return each_batch(stream, run, checkpoint)


def live_totals(changed: DataFrame, keys: Sequence[str], path: str, checkpoint: str) -> DataStreamWriter:
    """A table of totals: each batch writes those it changed, and earlier batches are merged by levels."""

    def run(df: DataFrame, number: int) -> None:
        totals = Levels(df.sparkSession, path, keys)
        if number:
            totals.compact(number - 1)
        totals.write(df, number)

    return each_batch(changed, run, checkpoint, "update")


def stream_threat_counts(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Live totals per threat type."""
    return live_totals(threat_type_counts(stream), ["anomaly_type"], path, checkpoint)


def stream_windowed_counts(stream: DataFrame, path: str, checkpoint: str, ts: str = "ts", late: str = "10 minutes",
                           size: str = "1 hour") -> DataStreamWriter:
    """Tumbling counts per type, with state bounded by a watermark."""
    counts = (stream.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), "anomaly_type")
              .agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "anomaly_type", "n"))
    return live_totals(counts, ["start", "anomaly_type"], path, checkpoint)


def latest_counts(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The current totals; the number of folders read follows the logarithm of the number of batches."""
    return Levels(spark, path, keys).read().drop(BATCH)
