"""Posted payloads: arrays of anomaly records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

RECORD = ("struct<log:struct<content:string,event_template:string,level:string,component:string,line_id:string>,"
          "anomaly_type:string,severity:string,confidence:double,anomaly_score:double,processing_mode:string,timestamp:string>")


def _records(value):
    is_array = F.startswith(F.ltrim(value), F.lit("["))
    return F.when(is_array & F.try_parse_json(value).isNotNull(), F.from_json(value, f"array<{RECORD}>"))


def accept_payloads(df: DataFrame, value: str = "value") -> DataFrame:
    """One row per record of each payload that is a JSON array."""
    kept = [c for c in df.columns if c != value]
    return df.select(*kept, F.explode(_records(F.col(value))).alias("_r")).select(*kept, "_r.*")


def reject_payloads(df: DataFrame, value: str = "value") -> DataFrame:
    """Payloads that are not a JSON array."""
    return df.filter(_records(F.col(value)).isNull())
