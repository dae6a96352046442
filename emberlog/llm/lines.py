"""Line dedup: lines found in many documents are kept in one document only.

1. Keys of long lines are counted as 128-bit hashes. A key that a third of all documents hold is
   one row per map task before anything is shuffled.
2. Only lines of repeated keys go on. They are range-partitioned by (hash, document descending,
   position) and sorted inside the ranges, so a hot key spreads over many ranges. Each range
   streams over its sorted rows and takes the first occurrence of each key; a key that began in an
   earlier range has its first occurrence there.
3. What is dropped comes back per document as a compressed bitmap: one 64-bit word per block of 64
   lines, blocks without a dropped line left out. Texts are joined to bitmaps, not shuffled with
   their lines.

Defined cases: a null or empty text is one empty line; a row is a document, so repeated rows count
as documents of their own; rows with the largest document id of a key all keep its lines; a null
id counts as the smallest; no rows give no rows. Other columns pass through, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.lookup import fits_broadcast, lookup_join
from ..workspace import Workspace
from .common import free_name, let, trimmed

MIN_CHARS, MIN_DOCS = 40, 5
# Null ids sort below all others.
NO_ID = -(1 << 63)


def _key(line: Column) -> Column:
    return F.translate(trimmed(line), string.ascii_uppercase, string.ascii_lowercase)


def _body(docs: DataFrame) -> DataFrame:
    """The document's id and a hash that tells rows of one id with different texts apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
                       F.xxhash64(text).alias("body"), F.split(text, "\n").alias("lines"))


def _hashed(line: Column) -> Column:
    """128 bits of the key of a line, null if it is too short."""
    pair = lambda k: F.when(F.length(k) >= MIN_CHARS, F.struct(
        F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2")))
    return F.when(F.length(line) >= MIN_CHARS, let(_key(line), pair))


def repeated_keys(docs: DataFrame, ws: Workspace) -> DataFrame:
    """Keys found in at least MIN_DOCS documents: h1, h2, docs."""
    each = F.array_distinct(F.array_compact(F.transform("lines", _hashed)))
    found = _body(docs).select(F.inline(each))
    return ws.stage(found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"))
                    .filter(F.col("docs") >= MIN_DOCS), "keys", measure=True)


def dropped(docs: DataFrame, ws: Workspace) -> DataFrame:
    """One row per document that loses lines: doc, body, keep_bitmap, n_dropped.

    ``keep_bitmap`` lists (block, bits): the bits set are lines to drop; all other lines are kept.
    """
    keys = repeated_keys(docs, ws)
    placed = (_body(docs).select("doc", "body", F.posexplode(F.transform("lines", _hashed)).alias("pos", "h"))
              .filter(F.col("h").isNotNull()).select("doc", "body", "pos", "h.h1", "h.h2"))
    lines = lookup_join(placed, keys, ["h1", "h2"], weight="docs").drop("docs")
    sort = ["h1", "h2", F.col("doc").desc(), "body", "pos"]
    ranged = ws.stage(lines.repartitionByRange(*sort).sortWithinPartitions(*sort)
                      .withColumn("range", F.spark_partition_id()), "lines")
    run = ["range", "h1", "h2"]
    streamed = ranged.withColumn("first", F.first("doc").over(
        Window.partitionBy(*run).orderBy(F.col("doc").desc(), "body", "pos")))
    # A key that lies in several ranges began in an earlier one: at most one such key per range border.
    carried = ws.stage(ranged.groupBy(*run).agg(F.max("doc").alias("m")).groupBy("h1", "h2")
                       .agg(F.count(F.lit(1)).alias("ranges"), F.max("m").alias("began"))
                       .filter(F.col("ranges") > 1).drop("ranges"), "carried", measure=True)
    gone = (streamed.join(F.broadcast(carried), ["h1", "h2"], "left")
            .filter(F.col("doc") != F.coalesce("began", "first")))
    bits = (gone.groupBy("doc", "body", F.shiftright("pos", 6).alias("block"))
            .agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits")))
    return bits.groupBy("doc", "body").agg(
        F.sort_array(F.collect_list(F.struct("block", "bits"))).alias("keep_bitmap"),
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"))


def _positions(bitmap: Column) -> Column:
    """Numbers of the lines that a bitmap drops."""
    block = lambda b: F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(b["bits"], i) == 1), lambda i: b["block"] * 64 + i)
    return F.flatten(F.transform(bitmap, block))


def deduplicate(docs: DataFrame, ws: Workspace, name: str = "line_dedup") -> DataFrame:
    """``docs`` with one struct column: n_lines, n_dropped, keep_bitmap and the text that is left."""
    bitmaps = ws.stage(dropped(docs, ws), "bitmaps", measure=True)
    doc, body, held = (free_name(docs, c) for c in ("_doc", "_body", "_held"))
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(body, F.xxhash64(text))
    found = bitmaps.select(F.col("doc").alias(doc), F.col("body").alias(body),
                           F.struct("keep_bitmap", "n_dropped").alias(held))
    joined = keyed.join(F.broadcast(found) if fits_broadcast(bitmaps) else found, [doc, body], "left")

    def kept(lines: Column) -> Column:
        all_ = F.sequence(F.lit(0), F.size(lines) - 1)
        return F.array_join(F.transform(F.array_except(all_, _positions(F.col(held)["keep_bitmap"])),
                                        lambda i: F.get(lines, i)), "\n")

    left = F.when(F.col(held).isNull(), text).otherwise(let(F.split(text, "\n"), kept))
    lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    out = F.struct(lines.alias("n_lines"), F.coalesce(F.col(held)["n_dropped"], F.lit(0).cast("long")).alias("n_dropped"),
                   F.col(held)["keep_bitmap"].alias("keep_bitmap"), left.alias("text"))
    return joined.withColumn(name, out).drop(doc, body, held)


def query(docs: DataFrame, ws: Workspace) -> DataFrame:
    rows = deduplicate(docs.select("doc_id", "text"), ws)
    return rows.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped",
                       F.sha2(F.col("line_dedup.text").cast("binary"), 256).alias("kept_sha256"))


def stage(docs: DataFrame, ws: Workspace) -> DataFrame:
    """``docs`` with each text cut down to the lines it keeps."""
    name = free_name(docs, "line_dedup")
    return deduplicate(docs, ws, name).withColumn("text", F.col(name)["text"]).drop(name)


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(doc_id, {NO_ID + 1}) AS doc, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
p AS (SELECT rid, doc, doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM d),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
  '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key FROM p),
c AS (SELECT key, max(doc) AS keeper FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT rid) >= {MIN_DOCS}),
m AS (SELECT rid, doc_id, i, line, c.key IS NOT NULL AND doc <> keeper AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY rid, doc_id"""
