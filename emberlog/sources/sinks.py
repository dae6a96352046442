"""Outputs: structured tables, catalogues, reports, and the append-only anomaly store."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import cleaning, detect
from ..workspace import Workspace

# Every value quoted, quotes doubled.
QUOTED = {"header": True, "quoteAll": True, "escape": '"'}


def write_structured(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Logs with their event: Parquet, or CSV with every value quoted."""
    _write(df, path, fmt)


def write_templates(catalogue: DataFrame, path: str, fmt: str = "parquet") -> None:
    _write(catalogue.select("event_id", "event_template", "occurrences"), path, fmt)


def _write(df: DataFrame, path: str, fmt: str) -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.options(**QUOTED).csv(path)
    else:
        writer.format(fmt).save(path)


def write_reports(found: "detect.Detection", folder: str) -> None:
    """Run summary (one row) and one folder of nested JSON records per mode of the run."""
    found.summary().write.mode("overwrite").json(f"{folder}/run")
    for name, rows in (("single_log_anomalies", found.single), ("sequential_anomalies", found.sequential),
                       ("hybrid_anomalies", found.hybrid)):
        if rows is not None:
            rows.write.mode("overwrite").json(f"{folder}/{name}")


def write_clean(df: DataFrame, path: str, ws: Workspace, aggressive: bool = True) -> None:
    """The cleaned table under ``data`` and its one-row report under ``report``."""
    staged = ws.stage(cleaning.with_stage(df, ws, aggressive), "cleaned")
    staged.filter("dropped_at is null").drop("dropped_at").write.mode("overwrite").parquet(f"{path}/data")
    cleaning.cleaning_report(staged, aggressive).write.mode("overwrite").parquet(f"{path}/report")


def store_entries(records: DataFrame, now: Column | None = None) -> DataFrame:
    """Records as stored: a missing or empty time stamp becomes the time of insertion."""
    now = F.current_timestamp() if now is None else now
    stamp = F.coalesce(F.nullif("timestamp", F.lit("")), F.date_format(now, "HH:mm:ss"))
    return records.withColumn("timestamp", stamp).withColumn("ingest_ts", now).withColumn("ingest_date", F.to_date(now))


def append_anomalies(records: DataFrame, path: str, now: Column | None = None) -> None:
    """Append to the store, which is partitioned by day of insertion."""
    store_entries(records, now).write.mode("append").partitionBy("ingest_date").parquet(path)


def export_batch(df: DataFrame, write: Callable[[DataFrame], None], attempts: int = 3, base: float = 2.0,
                 sleep: Callable[[float], None] = time.sleep) -> int:
    """Deliver a batch; wait 1, 2, 4 … seconds between attempts. Returns the number of attempts made.

    ``write`` must be idempotent, such as overwriting the folder of this batch.
    """
    for attempt in range(attempts):
        try:
            write(df)
            return attempt + 1
        except Exception:
            if attempt == attempts - 1:
                raise
            sleep(base ** attempt)
    raise ValueError("attempts must be positive")
