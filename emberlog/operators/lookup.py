"""Look-up joins that stay balanced when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..workspace import row_chars, sized_like, table_size

# Limits of what is broadcast: rows, and characters held by all columns together.
BROADCAST_ROWS = 500_000
BROADCAST_CHARS = 64_000_000
# A table of hot keys holds at most HOT_ROWS rows of at most HOT_CHARS characters each.
HOT_ROWS = 20_000
HOT_CHARS = 1_000
# Hot keys with longer rows are dealt to so many parts by a shuffle.
SALTS = 64


def fits_broadcast(df: DataFrame) -> bool:
    """Whether every executor may hold a copy of the table."""
    rows, chars = table_size(df)
    return rows <= BROADCAST_ROWS and chars <= BROADCAST_CHARS


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner",
                weight: str | None = None, nulls: bool = False) -> DataFrame:
    """Join ``left`` to a staged look-up table ``right`` (unique on ``on``), inner or left.

    A small table is broadcast. A larger one is split: keys that hold more than 1/HOT_ROWS of the
    rows of ``left`` (``weight`` counts them, so at most HOT_ROWS keys qualify) are joined by a
    broadcast of bounded size, or dealt to SALTS parts if their rows are long; all other rows are
    joined by a shuffle in which no key is hot. With ``nulls`` a null key is a key like any other;
    else it finds nothing, on every path.
    """
    if nulls:
        # A struct is never null, and structs with equal fields are equal, nulls included.
        keyed = right.select(F.struct(*on).alias("_key"), *[c for c in right.columns if c not in on])
        joined = lookup_join(left.withColumn("_key", F.struct(*on)), sized_like(keyed, right), ["_key"], how, weight)
        return joined.drop("_key").select(*on, *[c for c in joined.columns if c not in (*on, "_key")])
    if fits_broadcast(right):
        return left.join(F.broadcast(right), on, how)
    if weight is None:
        return left.join(right, on, how)
    total = right.agg(F.sum(weight)).first()[0] or 0
    heavy = F.col(weight) * HOT_ROWS >= total
    long = row_chars(right) > HOT_CHARS
    hot = right.filter(heavy & ~long)
    keys = hot.select(*on)
    hot_rows = left.join(F.broadcast(hot), on, "inner")
    missing = F.lit(False)
    for key in on:
        missing = missing | F.col(key).isNull()
    rest = left.filter(~missing).join(F.broadcast(keys), on, "left_anti")
    # Keys with long rows are known by their hash, eight bytes each.
    wide = right.filter(heavy & long).select(F.xxhash64(*on).alias("_hash"), F.lit(True).alias("_wide")).distinct()
    marked = lambda df: df.withColumn("_hash", F.xxhash64(*on)).join(F.broadcast(wide), "_hash", "left").drop("_hash")
    dealt = marked(rest).withColumn("_salt", F.when(F.col("_wide"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0).cast("int"))
    salts = F.when(F.col("_wide"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    cold = marked(right.filter(~heavy | long)).withColumn("_salt", F.explode(salts)).drop("_wide")
    cold_rows = dealt.drop("_wide").join(cold, [*on, "_salt"], how).drop("_salt")
    out = hot_rows.unionByName(cold_rows)
    if how == "left":
        # A null key finds nothing, so its rows need not meet in one task.
        out = out.unionByName(left.filter(missing), allowMissingColumns=True)
    return out
