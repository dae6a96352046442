"""Questions of the live view: newest rows, threats, shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.rulebook import THREAT_TYPES


def is_threat(kind: Column, types: Sequence[str] = THREAT_TYPES) -> Column:
    return F.coalesce(kind.isin(*types), F.lit(False))


def with_threat_flag(df: DataFrame, kind: str = "anomaly_type") -> DataFrame:
    return df.withColumn("is_threat", is_threat(F.col(kind)))


def normalize_timestamp(raw: Column, today: str) -> Column:
    """Missing → 'No timestamp'; a bare time gets today's date; otherwise date and time, or as it was."""
    parsed = F.date_format(F.try_to_timestamp(raw), "yyyy-MM-dd HH:mm:ss")
    return (F.when(F.coalesce(raw, F.lit("")) == "", "No timestamp")
            .when(F.length(raw) < 10, F.concat(F.lit(today + " "), raw))
            .otherwise(F.coalesce(parsed, raw)))


def latest_logs(store: DataFrame, order: str, n: int = 100) -> DataFrame:
    return store.orderBy(F.desc(order)).limit(n)


def recent_threats(store: DataFrame, order: str, n: int = 5) -> DataFrame:
    return latest_logs(store.filter(is_threat(F.col("anomaly_type"))), order, n)


def threat_share(store: DataFrame) -> DataFrame:
    threats = F.count_if(is_threat(F.col("anomaly_type")))
    total = F.count(F.lit(1))
    share = F.coalesce(F.round(F.try_divide(100.0 * threats, total), 1), F.lit(0.0))
    return store.agg(threats.alias("threats"), (total - threats).alias("non_threats"), share.alias("threat_pct"))


def threat_type_counts(store: DataFrame) -> DataFrame:
    return (store.filter(is_threat(F.col("anomaly_type"))).groupBy("anomaly_type")
            .agg(F.count(F.lit(1)).alias("n")))


def threat_timeline(store: DataFrame, order: str, n: int = 10) -> DataFrame:
    """The newest n rows, oldest first, with a running number of threats. The window sees n rows."""
    newest = with_threat_flag(latest_logs(store, order, n)).withColumn("threat", F.col("is_threat").cast("int"))
    running = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return newest.select("*", F.lit(1).alias("log"), F.sum("threat").over(running).alias("threats_so_far"))


def top_anomalies(store: DataFrame, order: str, n: int = 3, cut: int = 60, first_logs: int = 3) -> DataFrame:
    """The first n anomalies of each mode, contents cut. Each task keeps n rows per mode before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("processing_mode").orderBy(order))
    return (store.withColumn("rank", rank).filter(F.col("rank") <= n)
            .withColumn("content", F.substring(F.element_at("contents", 1), 1, cut))
            .withColumn("first_contents", F.transform(F.slice("contents", 1, first_logs), lambda c: F.substring(c, 1, cut))))
