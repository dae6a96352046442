"""Removal of repeated 100-byte strings by prefix-free parsing.

Parse. A rolling hash runs over the bytes of each document. Of the grams of GRAM bytes inside every
window of LENGTH bytes the one with the least hash, the rightmost of equals, is the window's
trigger; a phrase is what neighbouring windows with one trigger cover. Each window lies in exactly one
phrase, phrases overlap by LENGTH - 1 bytes, and equal windows have equal triggers wherever they lie.

Dictionary and corpus order. Phrases that occur again are one entry of the dictionary; all but the
first occurrence (smallest document, earliest start) repeat whole, and no byte of them is looked at
again. What is left is to compare the suffixes of different phrases with one trigger: their windows
are sorted as 64-bit hashes beside the trigger's, ties in corpus order, and all but the first of a run of
equals repeat. A phrase whose trigger is alone is never compared. Suffixes are sorted only as far
as LENGTH bytes, which is what the question needs.

Balance. Each task first folds the phrases that it meets more than once, so a passage in a third
of all documents is one row per batch. A trigger with very many different surroundings (the edge
of such a passage) is dealt by its windows instead. A sample of documents names the hottest beforehand, so
that their phrases are spread from the start; any other trigger is counted while its sorted phrases, of all
documents, stream through their task, and is dealt by windows beyond MOST of them. No task holds more
than MOST phrases of one trigger, nor more than MOST copies of one window, and a batch. Only where
rows go depends on the sample and the count, never the result.

Defined cases: a null text is the empty text; texts of less than LENGTH bytes keep all bytes; rows of
equal id and text are one document and get the same result; rows of equal id with different texts
are ordered by a hash of the text; a null id is the smallest; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.lookup import fits_broadcast
from ..workspace import Workspace
from . import hashing
from .common import free_name
from .encoder import tidy

LENGTH, GRAM = 100, 32
# One document in SAMPLE names hot triggers: those with over HOT_SEEN different phrases in the sample.
SAMPLE, HOT_SEEN, HOT_MOST = 64, 30, 20_000
NO_ID = -(1 << 63)
# Rows that a task folds at a time, and rows of one key that it holds at a time.
FOLD_ROWS, MOST = 1 << 18, 1 << 13
# Kinds of rows: resolve by trigger; dealt by window; known to repeat.
BY_TRIGGER, BY_WINDOW, REPEATS = 0, 1, 2
_PHRASE = "key long, hash long, doc long, body long, start long, windows int, kind int"


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, from minima over powers of two."""
    least, span = h, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    return np.minimum(least[:-rest], least[rest:]) if rest else least


def parse(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Phrases of UTF-8 rows: row, first window, number of windows, trigger hash, phrase hash."""
    none = np.zeros(0, np.int64)
    size = np.diff(offsets)
    rows = np.flatnonzero(size >= LENGTH)
    if not len(rows):
        return none, none, none, none, none
    grams = hashing.windows(data, GRAM)
    width = LENGTH - GRAM + 1
    least = _sliding_min(grams, width)
    first, last = offsets[rows], offsets[rows + 1] - LENGTH
    # Windows are valid where they end inside their row.
    change = np.zeros(len(least) + 1, np.int32)
    change[first] += 1
    change[last + 1] -= 1
    valid = np.cumsum(change[:-1]) > 0
    enters = grams[width - 1:] == least
    afresh = np.zeros(len(least), bool)
    afresh[1:] = least[1:] > least[:-1]
    afresh[first] = True
    start = np.flatnonzero((enters | afresh) & valid)
    trigger = start + width - 1
    search = np.flatnonzero(~enters[start])
    back = np.arange(width - 1, -1, -1)
    for i in range(0, len(search), 1 << 14):
        part = search[i:i + (1 << 14)]
        near = start[part][:, None] + back
        trigger[part] = near[np.arange(len(part)), grams[near].argmin(1)]
    row = np.searchsorted(offsets, start, "right") - 1
    end = np.append(start[1:], 0)
    close = np.append(row[1:] != row[:-1], True)
    end[close] = offsets[row[close] + 1] - LENGTH + 1
    return (row, start - offsets[row], end - start, grams[trigger].view(np.int64),
            hashing.slices(data, start, end + LENGTH - 1).view(np.int64))


def _split(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 19):
    """Pieces of rows of bounded size: (rows, bytes, offsets, start of each row's part).

    A row longer than a piece is cut into parts that overlap by LENGTH - 1 bytes, so every window
    lies in one part. A phrase that is cut there is two phrases with one trigger.
    """
    for first, end, part, at in hashing.pieces(data, offsets, most):
        if end - first > 1 or len(part) <= 2 * most:
            yield np.arange(first, end), part, at, np.zeros(end - first, np.int64)
            continue
        for a in range(0, len(part) - LENGTH + 1, most):
            some = part[a:a + most + LENGTH - 1]
            yield np.array([first]), some, np.array([0, len(some)]), np.array([a])


def _first(key, hash_, doc, body, start, before=None) -> tuple[np.ndarray, np.ndarray, tuple | None]:
    """Of rows sorted by all five columns: first of their (key, hash), the same place once more, and the last first row.

    Rows of one id and text are one document, so its second row is the same place and no repeat. ``before``
    is the last first row of the rows that came before these.
    """
    columns = (key, hash_, doc, body, start)
    if before is not None:
        columns = tuple(np.concatenate([np.array([v], c.dtype), c]) for v, c in zip(before, columns))
    key, hash_, doc, body, start = columns
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (hash_[1:] != hash_[:-1])
    of = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0)) if len(key) else np.zeros(0, np.int64)
    again = ~first & (doc == doc[of]) & (body == body[of]) & (start == start[of])
    skip = 0 if before is None else 1
    return first[skip:], again[skip:], tuple(c[of[-1]] for c in columns) if len(of) else None


def _key_parts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Table, bool]]:
    """A partition sorted by its first column as tables of whole keys; a key of more than ``most`` rows that goes
    beyond a batch comes in parts, which are marked."""
    held: list[pa.RecordBatch] = []
    parted = None
    whole = lambda: pa.Table.from_batches(held).combine_chunks()
    for batch in batches:
        key = np.asarray(batch.column(0))
        if parted is not None:
            end = int(np.searchsorted(key, parted, "right"))
            if end:
                yield pa.Table.from_batches([batch.slice(0, end)]), True
            batch, key = batch.slice(end), key[end:]
        if not len(key):
            continue
        parted = None
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            held.append(batch.slice(0, cut))
        if held and (cut or held[-1].column(0)[-1].as_py() != key[0]):
            yield whole(), False
            held = []
        held.append(batch.slice(cut))
        if sum(b.num_rows for b in held) > most:
            yield whole(), True
            held, parted = [], key[-1]
    if held:
        yield whole(), False


def _dealt(key, hash_, doc, body, start, windows, kind) -> pa.RecordBatch:
    """A batch of rows; those that repeat inside it are marked and dealt at random."""
    order = np.lexsort((start, body, doc, hash_, key))
    key, hash_, doc, body, start, windows, kind = (x[order] for x in (key, hash_, doc, body, start, windows, kind))
    first, again, _ = _first(key, hash_, doc, body, start)
    mixed = hashing.mixed((doc ^ start).view(np.uint64)).view(np.int64)
    columns = (np.where(first, key, mixed), hash_, doc, body, start, windows.astype(np.int32),
               np.where(first, kind, REPEATS).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(c[~again]) for c in columns],
                                      names=["key", "hash", "doc", "body", "start", "windows", "kind"])


def _phrases(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """``docs`` (doc, body, text) parsed. Hot triggers' phrases are dealt by their own hash."""
    held = docs.sparkSession.sparkContext.broadcast(np.sort(hot))

    def fold(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, hash_, *rest = (np.concatenate(x) for x in zip(*found))
        is_hot = np.isin(key, held.value) if len(held.value) else np.zeros(len(key), bool)
        return _dealt(np.where(is_hot, hash_, key), hash_, *rest, np.where(is_hot, BY_WINDOW, BY_TRIGGER))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, body = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            data, offsets = hashing.buffers(batch.column(2))
            found, many = [], 0
            for rows, part, at, shift in _split(data, offsets):
                row, start, windows, key, hash_ = parse(part, at)
                found.append((key, hash_, doc[rows[row]], body[rows[row]], start + shift[row], windows))
                many += len(key)
                if many >= FOLD_ROWS:
                    yield fold(found)
                    found, many = [], 0
            if found:
                yield fold(found)
        tidy()

    return docs.mapInArrow(run, _PHRASE)


_FOUND = "doc long, body long, start long, windows int, key long, kind int"
_ORDER = ("key", "hash", "doc", "body", "start")


def _found(doc, body, start, windows, key, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(doc), pa.array(body), pa.array(start), pa.array(windows.astype(np.int32)), pa.array(key),
         pa.array(kind.astype(np.int32))], names=["doc", "body", "start", "windows", "key", "kind"])


def _resolve_phrases(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Repeated phrases, and first occurrences whose trigger other phrases share."""
    before = None
    for table, part in _key_parts(batches, most):
        key, hash_, doc, body, start, windows, kind = (np.asarray(c) for c in table.columns)
        known = kind == REPEATS
        first, again, before = _first(key, hash_, doc, body, start, before)
        first &= ~known
        # Rows and different phrases per trigger.
        name = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1
        many = part | (np.bincount(name)[name] > most)
        kind = np.where(many & (kind == BY_TRIGGER), BY_WINDOW, kind)
        check = first & ((np.bincount(name, weights=first)[name] > 1) | (kind == BY_WINDOW))
        keep = check | (~first & (known | ~again))
        yield _found(doc[keep], body[keep], start[keep], windows[keep], key[keep],
                     np.where(check, kind, REPEATS)[keep])


_ASKED = f"{_PHRASE}, phrase binary"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, body, text, phrases to compare) to one row per phrase, with its bytes, to be compared
    with the phrases of its trigger; phrases of hot triggers to one row per window."""
    for batch in batches:
        doc, body = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        data, offsets = hashing.buffers(batch.column(2))
        asked = batch.column(3)
        at = np.asarray(asked.offsets)
        row = np.repeat(np.arange(batch.num_rows), np.diff(at))
        flat = asked.values.slice(at[0], at[-1] - at[0])
        start, count, key, kind = (np.asarray(flat.field(i)) for i in range(4))
        # A few thousand phrases at a time keep the arrays small.
        for i in range(0, len(row), 1 << 13):
            some = slice(i, i + (1 << 13))
            low, n = offsets[row[some]] + start[some], count[some].astype(np.int64)
            bytes_, edges = _slices(data, low, n + LENGTH - 1)
            where = (doc[row[some]], body[row[some]], start[some])
            lone = kind[some] == BY_WINDOW
            phrases = np.flatnonzero(~lone)
            if len(phrases):
                held, cuts = _slices(bytes_, edges[:-1][phrases], np.diff(edges)[phrases])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[some][phrases]), pa.array(np.zeros(len(phrases), np.int64)), *(pa.array(w[phrases]) for w in where),
                     pa.array(n[phrases].astype(np.int32)), pa.array(kind[some][phrases]),
                     pa.Array.from_buffers(pa.binary(), len(phrases), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(held)])],
                    names=_NAMES)
            if lone.any():
                of, inner, hash_ = _hashed_windows(bytes_, edges, np.where(lone, n, 0))
                made = _dealt(hash_, hash_, where[0][of], where[1][of], where[2][of] + inner, np.ones(len(of), np.int32),
                              np.full(len(of), BY_WINDOW))
                yield pa.RecordBatch.from_arrays([*made.columns, pa.nulls(made.num_rows, pa.binary())], names=_NAMES)


_NAMES = ["key", "hash", "doc", "body", "start", "windows", "kind", "phrase"]


def _slices(data: np.ndarray, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices of a buffer copied behind one another, and where each begins."""
    edges = np.concatenate([[0], np.cumsum(size)])
    return data[np.repeat(low - edges[:-1], size) + np.arange(edges[-1])], edges


def _hashed_windows(data: np.ndarray, edges: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``n`` windows of each slice: (slice, place in it, hash)."""
    total = np.cumsum(n)
    of = np.repeat(np.arange(len(n)), n)
    inner = np.arange(int(total[-1]) if len(total) else 0) - (total - n)[of]
    return of, inner, hashing.windows(data, LENGTH).view(np.int64)[edges[:-1][of] + inner]


def _resolve_windows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Windows that are not the first of their content, as runs of neighbouring windows.

    A trigger that is compared by its phrases has ``most`` of them at most, so only windows dealt by themselves come in parts.
    """
    before = None
    for table, _ in _key_parts(batches, most):
        key, hash_, doc, body, start, windows, kind = (np.asarray(c) for c in table.columns[:7])
        phrases = np.flatnonzero(kind == BY_TRIGGER)
        lone = np.flatnonzero(kind != BY_TRIGGER)
        data, edges = hashing.buffers(table.column(7).combine_chunks().take(pa.array(phrases)).cast(pa.large_binary()))
        of, inner, found = _hashed_windows(data, edges, windows[phrases].astype(np.int64))
        of = phrases[of]
        both = lambda a, b: np.concatenate([a, b])
        key, hash_, kind = both(key[lone], key[of]), both(hash_[lone], found), both(kind[lone], kind[of])
        doc, body, start = both(doc[lone], doc[of]), both(body[lone], body[of]), both(start[lone], start[of] + inner)
        order = np.lexsort((start, body, doc, hash_, key))
        key, hash_, doc, body, start, kind = (x[order] for x in (key, hash_, doc, body, start, kind))
        first, again, before = _first(key, hash_, doc, body, start, before)
        keep = (~first & ~again) | (kind == REPEATS)
        doc, body, start = doc[keep], body[keep], start[keep]
        order = np.lexsort((start, body, doc))
        doc, body, start = doc[order], body[order], start[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (body[1:] != body[:-1]) | (start[1:] > start[:-1] + 1)
        at = np.flatnonzero(new)
        last = start[np.append(at[1:], len(doc)) - 1] if len(at) else at
        yield _found(doc[at], body[at], start[at], last - start[at] + 1, np.zeros(len(at), np.int64), np.full(len(at), REPEATS))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, body, list of [from, to)) with their spans sorted, and joined where they touch."""
    for batch in batches:
        lists = batch.column(2)
        at = np.asarray(lists.offsets)
        flat = lists.values.slice(at[0], at[-1] - at[0])
        a, b = (np.asarray(flat.field(i)) for i in range(2))
        row = np.repeat(np.arange(batch.num_rows), np.diff(at))
        order = np.lexsort((a, row))
        a, b, row = a[order], b[order], row[order]
        # The furthest end so far in the same row: rows are set apart by more than any text is long.
        far = np.maximum.accumulate(b + (row << 40)) - (row << 40) if len(b) else b
        new = np.ones(len(a), bool)
        new[1:] = (row[1:] != row[:-1]) | (a[1:] > far[:-1])
        first = np.flatnonzero(new)
        end = far[np.append(first[1:], len(a)) - 1] if len(first) else first
        cuts = np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=batch.num_rows))]).astype(np.int32)
        spans = pa.StructArray.from_arrays([pa.array(a[first]), pa.array(end)], names=["a", "b"])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(cuts), spans)],
                                         names=["doc", "body", "spans"])


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
                       F.xxhash64(text).alias("body"), text.alias("text"))


def hot_triggers(keyed: DataFrame) -> np.ndarray:
    """Triggers with many different phrases in a sample, to be spread from the start; at most HOT_MOST, so the driver may hold them."""
    sample = _phrases(keyed.filter(F.pmod(F.xxhash64("doc", "body"), F.lit(SAMPLE)) == 0), np.zeros(0, np.int64))
    counts = (sample.filter(F.col("kind") == BY_TRIGGER).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
              .filter(F.col("n") > HOT_SEEN).orderBy(F.col("n").desc()).limit(HOT_MOST))
    return np.array([r.key for r in counts.collect()], np.int64)


def repeated(docs: DataFrame, ws: Workspace) -> DataFrame:
    """One row per document that has repeats: doc, body, spans (sorted, disjoint [from, to) of bytes)."""
    keyed = _keyed(docs)
    phrases = _phrases(keyed, hot_triggers(keyed)).repartition("key").sortWithinPartitions(*_ORDER)
    found = ws.stage(phrases.mapInArrow(partial(_resolve_phrases, most=MOST), _FOUND), "phrases")
    asked = ws.stage(found.filter(F.col("kind") != REPEATS).groupBy("doc", "body").agg(
        F.sort_array(F.collect_list(F.struct("start", "windows", "key", "kind"))).alias("asked")), "asked", measure=True)
    texts_ = keyed.join(F.broadcast(asked) if fits_broadcast(asked) else asked, ["doc", "body"])
    windows = (texts_.select("doc", "body", "text", "asked").mapInArrow(_windows, _ASKED)
               .repartition("key").sortWithinPartitions(*_ORDER).mapInArrow(partial(_resolve_windows, most=MOST), _FOUND))
    spans = (found.filter(F.col("kind") == REPEATS).unionByName(windows)
             .select("doc", "body", F.struct(F.col("start").alias("a"), (F.col("start") + F.col("windows") + (LENGTH - 1)).alias("b")).alias("s")))
    lists = spans.groupBy("doc", "body").agg(F.collect_list("s").alias("spans"))
    return ws.stage(lists.mapInArrow(_merged, "doc long, body long, spans array<struct<a:long,b:long>>"), "spans", measure=True)


def _cut(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The bytes outside all spans, and the number of maximal removed runs."""
    kept, at, runs, reach = [], 0, 0, -1
    for a, b in sorted(spans):
        if a > reach:
            kept.append(data[at:a])
            runs += 1
        reach = max(reach, b)
        at = reach
    kept.append(data[at:])
    return b"".join(kept), runs


def remove(docs: DataFrame, ws: Workspace, name: str = "substring_dedup") -> DataFrame:
    """``docs`` with one struct column: n_bytes, n_removed, n_spans, kept_sha256 and the text left.

    A removed run may begin or end inside a character; the bytes of it that stay are left out of
    ``text`` (not of ``kept_sha256``).
    """
    spans = repeated(docs, ws)
    doc, body, held = (free_name(docs, c) for c in ("_doc", "_body", "_spans"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    small = spans.select(F.col("doc").alias(doc), F.col("body").alias(body), F.col("spans").alias(held))
    joined = (docs.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(body, F.xxhash64(text))
              .join(F.broadcast(small) if fits_broadcast(spans) else small, [doc, body], "left"))

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")
    def cut(text, spans):
        import pandas as pd

        out = []
        for value, held in zip(text, spans):
            data = value.encode()
            left, runs = _cut(data, [(s["a"], s["b"]) for s in held]) if held is not None else (data, 0)
            out.append((len(data), len(data) - len(left), runs, hashlib.sha256(left).hexdigest(),
                        left.decode("utf-8", "ignore")))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    return joined.withColumn(name, cut(text, F.col(held))).drop(doc, body, held)


def query(docs: DataFrame, ws: Workspace) -> DataFrame:
    rows = remove(docs.select("doc_id", "text"), ws)
    return rows.select("doc_id", *[f"substring_dedup.{c}" for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")])


def stage(docs: DataFrame, ws: Workspace) -> DataFrame:
    """``docs`` with each text cut down to the bytes that are not repeated."""
    name = free_name(docs, "substring_dedup")
    return remove(docs, ws, name).withColumn("text", F.col(name)["text"]).drop(name)
