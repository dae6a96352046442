"""Raw log files and parsed tables."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import snake, strip
from ..workspace import Workspace
from ..operators.lookup import lookup_join

# What unpacking raises on content that is not packed.
BROKEN = ("java.util.zip.ZipException", "java.io.EOFException", "java.io.IOException")
SPLIT = ["path", "block"]


def _readable(value: Column) -> Column:
    """Text without bytes that are no UTF-8."""
    return F.when(F.is_valid_utf8(value), value).otherwise(F.replace(F.make_valid_utf8(value), F.lit("�"), F.lit("")))


def read_logs(spark: SparkSession, paths: str | Sequence[str], **options) -> DataFrame:
    """(file, path, block, pos, value): stripped lines of plain, gz or bz2 files.

    ``path``, ``block`` (start of the split) and ``pos`` give the order of the lines: text has no
    other, and a scan does not return its files in order. ``file`` is the base name, which files of
    several folders may share.
    """
    rows = spark.read.options(**options).text(paths if isinstance(paths, str) else list(paths))
    return rows.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                       F.monotonically_increasing_id().alias("pos"), strip(_readable(F.col("value"))).alias("value"))


def read_rotated(spark: SparkSession, folder: str, base: str = "messages") -> DataFrame:
    """Lines of ``messages``, ``messages.1``, ``messages.2.gz`` …; each file is read once."""
    rows = read_logs(spark, folder, pathGlobFilter=f"{base}*")
    return rows.filter(F.col("file").rlike(rf"^{base}(\..*)?$"))


def number_lines(rows: DataFrame, ws: Workspace, name: str = "line_id") -> DataFrame:
    """1-based numbers of the remaining lines, in path, block and line order; the lines are not shuffled.

    The rows of a split keep their order and are numbered within it by their position; the prefix sums
    run over one row per split of a file, and over one row per file.
    """
    staged = ws.stage(rows.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    splits = staged.groupBy(*SPLIT).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    files = splits.groupBy("path").agg(F.sum("_n").alias("_lines"))
    files = files.select("path", (F.sum("_lines").over(Window.orderBy("path")) - F.col("_lines")).alias("_files"))
    inner = F.sum("_n").over(Window.partitionBy("path").orderBy("block")) - F.col("_n")
    splits = splits.withColumn("_inner", inner).join(files, "path").withColumn("_before", F.col("_files") + F.col("_inner"))
    splits = ws.stage(splits.drop("_files", "_inner"), "splits", measure=True)
    return (lookup_join(staged, splits, SPLIT, weight="_n")
            .withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1)
            .drop("_at", "_first", "_n", "_before"))


def read_structured(spark: SparkSession, paths: str | Sequence[str], multi_line: bool = False) -> DataFrame:
    """A structured CSV with header and doubled quotes; names in snake case, empty values as null.

    ``multi_line`` reads quoted line breaks, at the price of one task per file.
    """
    rows = spark.read.csv(paths if isinstance(paths, str) else list(paths), header=True, quote='"', escape='"',
                          multiLine=multi_line)
    return rows.select(*[F.nullif(F.col(f"`{c}`"), F.lit("")).alias(snake(c)) for c in rows.columns])


def _headers(spark: SparkSession, pattern: str, skipped: list[str]) -> dict[str, list[str]]:
    """Files per header line. Only the first line of each file is read, unpacked by its suffix.

    Files whose first line is no text are named in ``skipped``; any other failure is raised.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[str, list[str]] = {}
    for status in fs.globStatus(path) or []:
        if status.isDirectory():
            continue
        stream = fs.open(status.getPath())
        codec = codecs.getCodec(status.getPath())
        try:
            opened = codec.createInputStream(stream) if codec is not None else stream
            header = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(opened, "UTF-8")).readLine()
        except Py4JJavaError as error:
            # Content that is no packed file although its name says so.
            if error.java_exception.getClass().getName() not in BROKEN:
                raise
            header = "\0"
        finally:
            stream.close()
        if header and ("\0" in header or "\ufffd" in header):
            skipped.append(status.getPath().toString())
        elif header:
            found.setdefault(header, []).append(status.getPath().toString())
    return found


def union_csv(spark: SparkSession, pattern: str, skipped: list[str] | None = None) -> DataFrame:
    """All CSV files of a glob as one table; columns that a file lacks are null.

    Files that hold no text are left out; their names are added to ``skipped``. A file that cannot
    be opened or read is an error.

    Files with the same header are one scan, so the plan grows with the kinds of file, not their number.
    """
    out = None
    for _, files in sorted(_headers(spark, pattern, skipped if skipped is not None else []).items()):
        rows = spark.read.csv(files, header=True, escape='"')
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"no readable CSV file matches {pattern}")
    return out
