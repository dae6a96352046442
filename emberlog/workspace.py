"""Intermediate tables written to the cluster's shared folder.

A staged table cuts lineage: it survives the loss of any executor, its columns are pruned when
read back, and its size is known before a join is planned.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from .session import ship


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="emberlog-")
    context.setCheckpointDir(folder)
    return folder


def _width(value: Column, kind: T.DataType) -> Column:
    """Characters or bytes that a value holds beside its fixed part, whatever it is nested in."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.length(value), F.lit(0)).cast("long")
    if isinstance(kind, T.StructType):
        total = F.lit(0).cast("long")
        for field in kind.fields:
            total = total + _width(value.getField(field.name), field.dataType)
        return total + 8 * len(kind.fields)
    if isinstance(kind, T.ArrayType):
        slots = 8 * F.greatest(F.coalesce(F.size(value), F.lit(0)), F.lit(0)).cast("long")
        if not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType, T.MapType)):
            return slots
        held = F.aggregate(value, F.lit(0).cast("long"), lambda n, x: n + _width(x, kind.elementType))
        return slots + F.coalesce(held, F.lit(0).cast("long"))
    if isinstance(kind, T.MapType):
        return (_width(F.map_keys(value), T.ArrayType(kind.keyType)) + _width(F.map_values(value), T.ArrayType(kind.valueType)))
    return F.lit(0).cast("long")


def row_chars(df: DataFrame) -> Column:
    """Characters of a row's strings, and eight per array element or nested field, at any depth."""
    width = F.lit(0).cast("long")
    for field in df.schema.fields:
        width = width + _width(F.col(f"`{field.name}`"), field.dataType)
    return width


def _with_size(df: DataFrame, size: tuple[int, int] | None) -> DataFrame:
    if size is not None:
        df._emberlog_size = size
    return df


def sized_like(df: DataFrame, measured: DataFrame) -> DataFrame:
    """Mark ``df``, which has no more or wider rows than ``measured``, as measured too."""
    return _with_size(df, getattr(measured, "_emberlog_size", None))


def table_size(df: DataFrame) -> tuple[int, int]:
    """(rows, characters): as measured when staged, else by one pass."""
    size = getattr(df, "_emberlog_size", None)
    if size is None:
        row = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(row_chars(df)).alias("chars")).first()
        size = (row.rows, row.chars or 0)
    return size


class Workspace:
    """One run's folder of staged tables. ``drop()`` once the run's results were written."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        ship(spark)
        self.spark = spark
        self.folder = f"{root or shared_folder(spark)}/run-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"

    def stage(self, df: DataFrame, name: str, measure: bool = False) -> DataFrame:
        """Write ``df`` as Parquet and return a scan of what was written.

        ``measure`` counts rows and characters while writing, for tables that will be looked up.
        """
        path, schema, size = self.path(name), df.schema, None
        if measure:
            size = Observation()
            df = df.observe(size, F.count(F.lit(1)).alias("rows"), F.sum(row_chars(df)).alias("chars"))
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        return out if size is None else _with_size(out, (size.get["rows"], size.get["chars"] or 0))

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
