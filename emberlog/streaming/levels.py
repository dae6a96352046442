"""Tables that batches of a stream change: deltas per batch, merged level by level.

Batch ``n`` writes the rows it changed, one per key, to a folder of its own. Every FAN_IN neighbouring
folders of one level are merged into one of the next, newest row per key, and then removed. So a reader opens
at most FAN_IN - 1 folders a level, some 7 log8(n) in all, and a row is rewritten once a level instead of once a
batch.

A folder is named by the batches it covers and counts once its writer has finished. Batches are merged
when a later batch begins, which Spark starts only after they are committed. So a batch that is run
again finds the table as it was before it, and writes the same folder again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

FAN_IN = 8
BATCH = "batch_id"


class Levels:
    """Rows by ``keys`` in a folder; ``idle`` batches without a change and a key is forgotten (None: never)."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], idle: int | None = None, fan_in: int = FAN_IN):
        self.spark, self.path, self.keys, self.idle, self.fan_in = spark, path, list(keys), idle, fan_in
        jvm = spark.sparkContext._jvm
        self._hadoop = jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _folder(self, first: int, last: int) -> str:
        return f"{self.path}/from={first}/to={last}"

    def _covers(self) -> list[tuple[int, int]]:
        """Finished folders, as (first, last batch)."""
        found = self._fs.globStatus(self._hadoop(f"{self.path}/from=*/to=*/_SUCCESS")) or []
        parts = [status.getPath().getParent() for status in found]
        return sorted((int(p.getParent().getName()[5:]), int(p.getName()[3:])) for p in parts)

    def live(self, last: int | None = None) -> list[tuple[int, int]]:
        """The fewest folders that hold the batches up to ``last``, in order."""
        covers = [c for c in self._covers() if last is None or c[1] <= last]
        out, at = [], 0
        while own := [c for c in covers if c[0] == at]:
            out.append(max(own))
            at = out[-1][1] + 1
        if last is not None and at <= last:
            raise FileNotFoundError(f"batch {at} is missing in {self.path}")
        return out

    def _newest(self, covers: list[tuple[int, int]]) -> DataFrame:
        rows = self.spark.read.parquet(*[self._folder(*c) for c in covers])
        if len(covers) > 1:
            key = F.struct(*self.keys).alias("_key")
            rows = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), BATCH).alias("_row")).select("_row.*")
        return rows if self.idle is None else rows.filter(F.col(BATCH) >= covers[-1][1] - self.idle)

    def read(self, last: int | None = None, schema: StructType | None = None) -> DataFrame:
        """The newest row of every key, as of a batch (None: the last one); ``schema`` is that of no batches."""
        covers = self.live(last)
        if not covers:
            if schema is None:
                raise FileNotFoundError(f"no batch in {self.path}")
            return self.spark.createDataFrame([], schema).withColumn(BATCH, F.lit(0).cast("long"))
        return self._newest(covers)

    def compact(self, last: int) -> None:
        """Merge what may be merged of the committed batches up to ``last``."""
        span = self.fan_in
        while span <= last + 1:
            first = (last + 1) // span * span - span
            covers = [c for c in self.live(last) if c[0] >= first and c[1] < first + span]
            whole = bool(covers) and covers[0][0] == first and covers[-1][1] == first + span - 1
            if whole and len(covers) > 1:
                self._newest(covers).write.mode("overwrite").parquet(self._folder(first, first + span - 1))
            span *= self.fan_in
        live = set(self.live(last))
        for first, end in self._covers():
            if end <= last and (first, end) not in live:
                self._fs.delete(self._hadoop(self._folder(first, end)), True)

    def write(self, rows: DataFrame, number: int) -> None:
        """The rows that a batch changed."""
        rows.withColumn(BATCH, F.lit(number).cast("long")).write.mode("overwrite").parquet(self._folder(number, number))
