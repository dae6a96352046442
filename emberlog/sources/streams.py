"""Streams of collected lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TOPIC, GROUP = "server-logs", "log-consumer-group"


def kafka_options(servers: str, topic: str = TOPIC, group: str = GROUP, start: str = "latest") -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "kafka.group.id": group, "startingOffsets": start}


def stream_kafka(spark: SparkSession, servers: str, extra: dict[str, str] | None = None, **options) -> DataFrame:
    """(value, timestamp) of a topic; needs the Kafka connector on the class path.

    Lost offsets stop the stream, as Spark's default has it; ``extra`` options may say otherwise.
    """
    rows = spark.readStream.format("kafka").options(**kafka_options(servers, **options)).options(**(extra or {})).load()
    return rows.select(F.col("value").cast("string").alias("value"), "timestamp")


def stream_text(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Lines of the files that arrive in a folder."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def stream_parquet(spark: SparkSession, folder: str, schema, files: str = "*.parquet",
                   files_per_batch: int | None = None) -> DataFrame:
    """Rows of the Parquet files of a folder whose names match ``files``."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)
