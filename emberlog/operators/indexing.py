"""Row numbers and exact percentiles without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..workspace import Workspace, table_size
from .lookup import lookup_join

# Up to this many rows the built-in percentile aggregate is used as it is.
IN_MEMORY_ROWS = 1_000_000
# Up to this many rows one task may number a table.
SMALL_ROWS = 100_000
_POSITION_BITS = (1 << 33) - 1


def _offsets(staged: DataFrame, amount) -> DataFrame:
    """Prefix sums over the range partitions. One row per partition, so the driver may hold them."""
    spark = staged.sparkSession
    rows = staged.groupBy("_pid").agg(amount.alias("n")).collect()
    table, running = [], 0
    for row in sorted(rows, key=lambda r: r._pid):
        table.append((row._pid, running))
        running += row.n
    return spark.createDataFrame(table, "_pid int, _offset long")


def _range_sorted(df: DataFrame, order: Sequence[str]) -> DataFrame:
    return (df.repartitionByRange(*order).sortWithinPartitions(*order)
            .withColumn("_pid", F.spark_partition_id())
            .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_BITS))))


def index_rows(df: DataFrame, order: Sequence[str], ws: Workspace, name: str = "idx",
               by: Sequence[str] = (), whole: str | None = None, count: str | None = None) -> DataFrame:
    """Add the 0-based position of each row in the order of ``order`` (within each ``by`` key).

    With keys, ``whole`` names a column for the position among all rows, in the order of the keys, and
    ``count`` one for the number of rows of the row's key.

    One range shuffle sorts the rows and is staged with each row's partition and position; the
    position in the whole table is that position plus the rows of all partitions before. A key
    that holds a third of the rows is spread over many range partitions like any other rows.
    ``order`` must identify rows. A table already measured as small is numbered by one window.
    """
    size = getattr(df, "_emberlog_size", None)
    if size is not None and size[0] <= SMALL_ROWS:
        window = Window.partitionBy(*by).orderBy(*order)
        out = df.withColumn(name, (F.row_number().over(window) - 1).cast("long"))
        if whole:
            out = out.withColumn(whole, (F.row_number().over(Window.orderBy(*by, *order)) - 1).cast("long"))
        return out.withColumn(count, F.count(F.lit(1)).over(Window.partitionBy(*by))) if count else out
    staged = ws.stage(_range_sorted(df, [*by, *order]), "indexed")
    out = (staged.join(F.broadcast(_offsets(staged, F.count(F.lit(1)))), "_pid")
           .withColumn(name, F.col("_offset") + F.col("_pos")).drop("_pid", "_pos", "_offset"))
    if not by:
        return out
    starts = ws.stage(out.groupBy(*by).agg(F.min(name).alias("_start"), F.count(F.lit(1)).alias("_rows")),
                      "key_starts", measure=True)
    out = lookup_join(out, starts, list(by), weight="_rows", nulls=True)
    if whole:
        out = out.withColumn(whole, F.col(name))
    if count:
        out = out.withColumn(count, F.col("_rows"))
    return out.withColumn(name, F.col(name) - F.col("_start")).drop("_start", "_rows")


def percentiles(df: DataFrame, value: str, points: Sequence[float], ws: Workspace,
                by: Sequence[str] = (), in_memory_rows: int = IN_MEMORY_ROWS) -> DataFrame:
    """Exact linear-interpolated percentiles: one row per ``by`` key with column ``pct``.

    ``pct`` is an array in the order of ``points`` (fractions). Equal values are counted before
    anything is sorted, so a value that fills a third of the table is one row of the sort.
    """
    by = list(by)
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    counted = ws.stage(rows.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_w")), "value_counts", measure=True)
    points = [float(p) for p in points]
    if table_size(counted)[0] <= in_memory_rows:
        fractions = F.array(*[F.lit(p) for p in points])
        return counted.groupBy(*by).agg(F.percentile("_v", fractions, F.col("_w")).alias("pct"))

    staged = ws.stage(_range_sorted(counted, [*by, "_v"]), "sorted_values")
    running = Window.partitionBy("_pid").orderBy("_pos")
    ranked = (staged.withColumn("_hi", F.sum("_w").over(running))
              .join(F.broadcast(_offsets(staged, F.sum("_w"))), "_pid")
              .withColumn("_hi", F.col("_hi") + F.col("_offset"))
              .withColumn("_lo", F.col("_hi") - F.col("_w")))
    ranked = ws.stage(ranked.select(*by, "_v", "_lo", "_hi").withColumn("_all", F.lit(1)), "ranked_values")
    keys = by or ["_all"]
    wanted = F.array(*[F.lit(p) for p in points])
    spans = (ranked.groupBy(*keys).agg(F.min("_lo").alias("_start"), F.max("_hi").alias("_end"))
             .withColumn("_at", F.transform(wanted, lambda p: p * (F.col("_end") - F.col("_start") - 1))))
    spans = ws.stage(spans, "spans", measure=True)
    ranks = F.array_distinct(F.concat(F.transform("_at", lambda a: F.floor(a)),
                                      F.transform("_at", lambda a: F.ceil(a))))
    hit = F.filter(ranks, lambda r: (r >= F.col("_lo") - F.col("_start")) & (r < F.col("_hi") - F.col("_start")))
    picked = (lookup_join(ranked, spans, keys, nulls=True)
              .withColumn("_rank", F.explode(hit))
              .groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at_rank"),
                                  F.first("_at").alias("_at")))
    low = lambda a: F.element_at("_at_rank", F.floor(a))
    high = lambda a: F.element_at("_at_rank", F.ceil(a))
    # The built-in aggregate's own formula, so that both ways give the same bits.
    pct = F.transform("_at", lambda a: F.when(low(a) == high(a), low(a)).otherwise(
        (F.ceil(a) - a) * low(a) + (a - F.floor(a)) * high(a)))
    return picked.select(*by, pct.alias("pct"))


def percentile_values(df: DataFrame, value: str, points: Sequence[float], ws: Workspace) -> list[float]:
    """The percentiles of a whole column as numbers; empty input gives an empty list."""
    row = percentiles(df, value, points, ws).first()
    return list(row.pct) if row and row.pct is not None else []
