"""Windows of a fixed number of consecutive records per key, over a stream.

Two ways give the same windows. ``stream_count_windows`` numbers each batch's records per key with a
range sort, so a key with a third of the records is spread over many tasks. What a key leaves over (less than
one window) and how many windows it has are one row of a levelled table; a batch reads and
writes the rows of its own keys, and keys without records for ``idle`` batches are forgotten.

``state_count_windows`` keeps the same in Spark's state store, with a time-out. Its keys are dealt by hash:
the records of one key and trigger are sorted in one task, so a key with a large share of the records needs triggers of
bounded size (``files_per_batch``) or the first way.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..operators.indexing import index_rows
from ..operators.lookup import lookup_join
from ..plans.rulebook import WINDOW_LENGTH
from ..workspace import Workspace
from .jobs import batch_folder, each_batch
from .levels import Levels


def window_batch(df: DataFrame, number: int, key: str, order: Sequence[str], path: str, carry: str, ws: Workspace,
                 size: int = WINDOW_LENGTH, idle: int | None = None) -> None:
    """Write the complete windows of one batch: key, win_id, offset and the record's columns."""
    columns = df.columns
    levels = Levels(df.sparkSession, carry, [key], idle)
    if number:
        levels.compact(number - 1)
    known = levels.read(number - 1, StructType([df.schema[key], StructField("_done", LongType()), StructField("_left", ArrayType(df.schema))]))
    # A null key is a key like any other.
    own = ws.stage(df.groupBy(key).agg(F.count(F.lit(1)).alias("_new")), "own", measure=True)
    held = known.join(F.broadcast(own) if own._emberlog_size[0] <= 100_000 else own, known[key].eqNullSafe(own[key]), "left_semi")
    held = ws.stage(held.select(key, "_done", "_left"), "held")
    numbered = index_rows(held.select(F.inline("_left")).unionByName(df), order, ws, "_idx", by=[key])
    totals = (own.select(key, F.col("_new").alias("_n"), F.lit(0).cast("long").alias("_done"))
              .unionByName(held.select(key, F.size("_left").cast("long").alias("_n"), "_done"))
              .groupBy(key).agg(F.sum("_n").alias("_n"), F.max("_done").alias("_done")))
    totals = ws.stage(totals, "totals", measure=True)
    placed = lookup_join(numbered, totals, [key], weight="_n", nulls=True)
    whole = F.floor(F.col("_n") / size) * size
    (placed.filter(F.col("_idx") < whole)
     .select(*columns, (F.col("_done") + F.floor(F.col("_idx") / size)).alias("win_id"), (F.col("_idx") % size).alias("offset"))
     .write.mode("overwrite").parquet(batch_folder(path, number)))
    # Less than one window per key.
    rest = placed.filter(F.col("_idx") >= whole).groupBy(F.struct(key).alias("_key")).agg(F.collect_list(F.struct(*columns)).alias("_left"))
    after = totals.select(F.struct(key).alias("_key"), key, (F.col("_done") + F.floor(F.col("_n") / size)).alias("_done"))
    none = F.array().cast(ArrayType(df.schema))
    levels.write(after.join(rest, "_key", "left").select(key, "_done", F.coalesce("_left", none).alias("_left")), number)


def stream_count_windows(stream: DataFrame, key: str, order: Sequence[str], path: str, carry: str, checkpoint: str,
                         size: int = WINDOW_LENGTH, idle: int | None = None) -> DataStreamWriter:
    """Emit every ``size`` consecutive records of a key as a window, in order of ``order`` within a batch.

    After ``idle`` batches without records a key begins anew, with window 0 and nothing left over.
    """

    def run(df: DataFrame, number: int) -> None:
        ws = Workspace(df.sparkSession)
        window_batch(df, number, key, order, path, carry, ws, size, idle)
        ws.drop()

    return each_batch(stream, run, checkpoint)


def state_count_windows(stream: DataFrame, key: str, order: Sequence[str], size: int = WINDOW_LENGTH, idle_ms: int | None = None) -> DataFrame:
    """The same windows as a stream, from Spark's state store: per key a count and less than ``size`` records.

    After ``idle_ms`` without records, by the clock, a key begins anew; such a query runs until it is stopped,
    also with the trigger ``availableNow``.
    """
    columns, kinds = stream.columns, stream.schema
    state_type = StructType([StructField("_done", LongType()), *[StructField(f.name, ArrayType(f.dataType)) for f in kinds.fields]])
    out = StructType([*kinds.fields, StructField("win_id", LongType()), StructField("offset", LongType())])

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        done, *left = state.get if state.exists else (0, *[[] for _ in columns])
        new = pd.concat(list(batches)).sort_values(list(order), kind="stable")
        rows = [list(a) + b.tolist() for a, b in zip(left, (new[c].astype(object).where(new[c].notna(), None) for c in columns))]
        n = len(rows[0]) // size * size
        state.update((done + n // size, *[r[n:] for r in rows]))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        if n:
            made = pd.DataFrame({c: r[:n] for c, r in zip(columns, rows)})
            yield made.assign(win_id=[done + i // size for i in range(n)], offset=[i % size for i in range(n)])

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return stream.groupBy(key).applyInPandasWithState(run, out, state_type, "append", timeout)
