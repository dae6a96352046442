"""What the operators share: reading, names that cannot clash, and values computed once in an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The white space that separates words: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` of every row and no other column; a null text is the empty text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body reads it.

    A plain column used inside a lambda is copied into it by the optimizer and would run again
    for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """All maximal runs without white space, in order."""
    blank = F.translate(text, SPACES, " " * len(SPACES))
    return F.array_remove(F.split(blank, " "), "")


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use yet."""
    taken = {c.lower() for c in df.columns}
    while base in taken:
        base = "_" + base
    return base


def bound(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Add a costly column that later steps read as a plain value: the optimizer cannot copy it."""
    return df.select("*", F.explode(F.array(value)).alias(name))
