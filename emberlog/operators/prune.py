"""Joins of a large table with few of its keys: rows of other keys go before anything is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..workspace import table_size
from .lookup import fits_broadcast

# Bits of the filter per key, and its size at most (32 MB, whatever the number of keys).
BITS_PER_KEY, MOST_BITS, LEAST_BITS = 16, 1 << 28, 1 << 18
# Bits in one row of the built-in bitmap aggregate.
_ROW_BITS = 32_768


def _number(key: Column, bits: int) -> Column:
    """The bit of a key, counted from 1 as the bitmap functions do."""
    return F.pmod(F.xxhash64(key), F.lit(bits)) + 1


def bloom_filter(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """One bit per key, by hash: rows (_bucket, _bits) of 4 KB, and the number of bits.

    The number follows the number of keys up to MOST_BITS, so what is broadcast is bounded; with more
    keys than that the filter lets more rows pass, never fewer.
    """
    wanted = max(LEAST_BITS, min(MOST_BITS, BITS_PER_KEY * table_size(keys)[0]))
    bits = 1 << (wanted - 1).bit_length()
    number = _number(F.col(key), bits)
    return (keys.groupBy(F.bitmap_bucket_number(number).alias("_bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("_bits"))), bits


def may_hold(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` whose key may be among ``keys``: all that are, and few others."""
    filter_, bits = bloom_filter(keys, key)
    number = _number(F.col(key), bits)
    place = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return (rows.withColumn("_bucket", F.bitmap_bucket_number(number)).join(F.broadcast(filter_), "_bucket")
            .filter(F.getbit(byte, (place % 8).cast("int")) == 1).drop("_bucket", "_bits"))


def join_few(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Inner join of ``rows`` with ``keys`` (unique on ``key``), which name few of them.

    Measured keys that fit are broadcast. Else a Bloom filter of bounded size drops nearly all rows of
    other keys where they are, and only the rest is shuffled.
    """
    if fits_broadcast(keys):
        return rows.join(F.broadcast(keys), key)
    return may_hold(rows, keys, key).join(keys, key)
