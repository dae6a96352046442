"""Windows of consecutive rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.rulebook import WINDOW_LENGTH, WINDOW_STRIDE
from ..workspace import Workspace
from .indexing import index_rows

# Columns of rows placed per key: position among all rows, rows of the key.
PLACE, KEY_ROWS = "place", "key_rows"


@dataclass
class Placed:
    """Rows in order: ``idx`` is a row's position, in its key if there is one; ``n`` counts the rows, as a column of
    the row's key if there is one. ``total`` is the number of all rows."""

    rows: DataFrame
    n: int | Column
    total: int
    key: str | None = None

    @property
    def place(self) -> str | None:
        return PLACE if self.key else None

    @property
    def helpers(self) -> list[str]:
        """What windows need beside ``idx``."""
        return [PLACE, KEY_ROWS] if self.key else []


def place_rows(rows: DataFrame, order: Sequence[str], ws: Workspace, key: str | None = None) -> Placed:
    """Number rows, with ``key`` each key's rows on their own; a null key is a key like any other.

    Numbers per key come from one range sort by key and order, so a key that holds a third of the
    rows is spread over many tasks. The result is staged.
    """
    if key is None:
        placed = ws.stage(index_rows(rows, order, ws, "idx"), "placed")
        total = placed.count()
        return Placed(placed, total, total)
    placed = ws.stage(index_rows(rows, order, ws, "idx", by=[key], whole=PLACE, count=KEY_ROWS), "placed")
    return Placed(placed, F.col(KEY_ROWS), placed.count(), key)


def sequence_windows(df: DataFrame, n: int | Column, seq_len: int = WINDOW_LENGTH, stride: int = WINDOW_STRIDE,
                     idx: str = "idx", tail: bool = False, place: str | None = None) -> DataFrame:
    """Each row once per window it belongs to: win_id, start_idx, offset.

    A window starts at every multiple of ``stride`` that is less than n - seq_len; with ``tail`` also
    the last one that just fits. ``idx`` is the row's 0-based position; ``n`` the number of rows (a
    column if positions are per key). With ``place``, the row's position among all keys, ``win_id`` is the
    place of the window's first row, which no two windows of any keys share.
    """
    at = F.col(idx)
    if stride >= seq_len:
        out = df.withColumn("win_id", F.floor(at / stride))
    else:
        first = F.greatest(F.lit(0), F.ceil((at - (seq_len - 1)) / stride))
        out = df.withColumn("win_id", F.explode(F.sequence(first, F.floor(at / stride))))
    out = (out.withColumn("start_idx", F.col("win_id") * stride)
           .withColumn("offset", F.col(idx) - F.col("start_idx")))
    fits = F.col("start_idx") <= n - seq_len if tail else F.col("start_idx") < n - seq_len
    out = out.filter((F.col("offset") < seq_len) & fits)
    return out if place is None else out.withColumn("win_id", F.col(place) - F.col("offset"))


def keyed_windows(rows: DataFrame, key: str, order: Sequence[str], ws: Workspace, seq_len: int = WINDOW_LENGTH,
                  stride: int = WINDOW_STRIDE) -> DataFrame:
    """All complete windows of each key's rows, numbered per key: what a stream of the same rows gives."""
    placed = place_rows(rows, order, ws, key)
    windows = sequence_windows(placed.rows, placed.n, seq_len, stride, tail=True)
    return windows.drop(*placed.helpers)


def window_error(windows: DataFrame, *errors: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean of each row error per window."""
    return windows.groupBy(*by, "win_id", "start_idx").agg(*[F.avg(e).alias(e) for e in errors])
