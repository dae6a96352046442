"""Collected payloads to canonical lines; the same plan for batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import syslog
from ..functions.text import strip
from .bind import bind


def classify_payload(df: DataFrame, value: str = "value") -> DataFrame:
    """Add ``is_json``, the envelope ``body``, and the ``message`` to parse: the body's or the payload."""
    df = bind(df, {"is_json": syslog.is_json_object(F.col(value))})
    df = bind(df, {"body": F.when(F.col("is_json"), syslog.envelope(F.col(value)))})
    return df.withColumn("message", F.when(F.col("is_json"), F.col("body.message")).otherwise(F.col(value)))


def parse_payloads(df: DataFrame, value: str = "value") -> DataFrame:
    """Add is_json, body, message and the struct of parsed fields (null where no layout fits)."""
    return with_syslog(classify_payload(df, value), "message")


def with_syslog(df: DataFrame, line: str, out: str = "parsed") -> DataFrame:
    """Add a struct of the fields of a syslog line; each layout is tried once per row."""
    df = bind(df, {"_layout": syslog.which_layout(F.col(line))})
    df = bind(df, {"_fields": syslog.syslog_fields(F.col(line), F.col("_layout"))})
    values = {name: F.get("_fields", F.lit(i)) for i, name in enumerate(syslog.FIELDS)}
    # Only a message may be empty; any other empty field is one that the line does not have.
    parsed = F.struct(*[(v if n == "message" else F.nullif(v, F.lit(""))).alias(n) for n, v in values.items()])
    return df.withColumn(out, F.when(F.col("_layout").isNotNull(), parsed)).drop("_layout", "_fields")


def route(df: DataFrame, value: str = "value") -> DataFrame:
    """Add ``route`` and the canonical ``output`` line.

    Routes: formatted, short (envelope text that fits no layout), noise, empty, unrecognized,
    invalid (no payload). Noise, empty and invalid rows have no output.
    """
    parsed = F.col("parsed")
    noise = (F.col("is_json") & syslog.is_noise(F.col("message"))) | (
        parsed.isNotNull() & syslog.from_noise_program(parsed))
    where = (F.when(F.col(value).isNull(), "invalid")
             .when(noise, "noise")
             .when(parsed.isNotNull(), "formatted")
             .when(~F.col("is_json"), "unrecognized")
             .when(strip(F.col("message")) == "", "empty")
             .otherwise("short"))
    output = (F.when(F.col("route") == "formatted", syslog.format_syslog(parsed))
              .when(F.col("route") == "short", syslog.short_line(F.col("body")))
              .when(F.col("route") == "unrecognized", F.col(value)))
    return parse_payloads(df, value).withColumn("route", where).withColumn("output", output)


def drop_noise(df: DataFrame, value: str = "value") -> DataFrame:
    """Payloads that are not noise."""
    return route(df, value).filter(F.col("route") != "noise")
