"""Compute a costly column once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def bind(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later steps read as plain values.

    A column added by ``withColumn`` is copied into every filter and expression that uses it; a long
    CASE over patterns would run again at each. Passing the values through a one-element ``inline``
    keeps them computed once per row, inside the same stage.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
