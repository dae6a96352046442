"""Toxicity: logistic regression over hashed n-grams and skip-grams, learned by FTRL-proximal.

Features of a text are its different words, pairs of neighbouring words and pairs with one word
between, hashed into 2**BITS buckets. FTRL keeps two numbers per bucket (the shifted sum of gradients
and the sum of their squares), which gives each coordinate its own learning rate, and L1 sets the
weights of uninformative buckets to zero. What is left is a short list that every task gets.

Fitting reads a sample of at most MAX_ROWS labelled documents, those whose hashed id is lowest; the
bound is a parameter. FTRL goes from text to text, so one task streams the sample once per round and
holds one batch of it. The driver holds the state only, whose size follows BITS and not the corpus.
Scoring reads every whole text, where it is.

Defined cases: words are runs of letters, digits and bytes beyond ASCII, without case for A-Z; a
null text is the empty text and scores by the intercept alone; a document labelled twice is toxic
if any label says so, a null label counts as no label; labels without a document are not used; with
no labels every score is 0.5; rows of equal ids are scored each; null ids are never held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import hashing

BITS = 20
MAX_ROWS, ROUNDS = 24_000, 2
ALPHA, BETA, L1, L2 = 2.0, 1.0, 4.0, 0.1
FOLDS = 5

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word, pair and skip-pair of UTF-8 rows, with repeats."""
    inside = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    stop[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    word = hashing.slices(_LOWER[data], start, end)
    rows, keys = [row], [word]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        if len(word) > gap:
            same = row[:-gap] == row[gap:]
            rows.append(row[:-gap][same])
            keys.append(hashing.mixed(word[:-gap][same] * np.uint64(salt) + word[gap:][same]))
    return np.concatenate(rows), (np.concatenate(keys) >> np.uint64(64 - BITS)).astype(np.int64)


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The proximal step: zero within L1 of the origin, else a rate of its own per coordinate."""
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _chance(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def _learn(z: np.ndarray, n: np.ndarray, buckets: np.ndarray, label: int) -> None:
    """One FTRL step for one text. The last coordinate is the intercept, which is not shrunk."""
    at = np.append(buckets, len(z) - 1)
    w = weights(z[at], n[at])
    w[-1] = -z[-1] / ((BETA + np.sqrt(n[-1])) / ALPHA)
    g = _chance(w.sum()) - label
    sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
    z[at] += g - sigma * w
    n[at] += g * g


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of all buckets and, last, the intercept. ``labels``: doc_id, toxic; all rows are used for learning."""
    spark = docs.sparkSession
    chosen = (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
              .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    examples = (rows.join(F.broadcast(chosen), "doc_id").select("text", "toxic")
                .repartition(1).sortWithinPartitions(F.xxhash64("text"), "text"))
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(rounds):
        state = spark.sparkContext.broadcast((z, n))

        def stream(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            z, n = (a.copy() for a in state.value)
            for batch in batches:
                data, offsets = hashing.buffers(batch.column(0))
                toxic = batch.column(1).to_pylist()
                for first, end, some, at in hashing.pieces(data, offsets):
                    row, bucket = features(some, at)
                    pair = np.unique(row << BITS | bucket)
                    cut = np.searchsorted(pair, np.arange(end - first + 1) << BITS)
                    for i in range(end - first):
                        _learn(z, n, pair[cut[i]:cut[i + 1]] & (1 << BITS) - 1, toxic[first + i])
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"at": pa.array([at.astype(np.int32).tobytes()]),
                                              "z": pa.array([z[at].tobytes()]), "n": pa.array([n[at].tobytes()])})

        # One row of at most 2**BITS + 1 coordinates.
        for made in examples.mapInArrow(stream, "at binary, z binary, n binary").collect():
            at = np.frombuffer(made.at, np.int32)
            z[at], n[at] = np.frombuffer(made.z), np.frombuffer(made.n)
        state.unpersist()
    out = weights(z, n)
    out[-1] = -z[-1] / ((BETA + np.sqrt(n[-1])) / ALPHA)
    return out


def score(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """One row per document: doc_id and the probability that its text is toxic."""
    held = docs.sparkSession.sparkContext.broadcast(model.astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            data, offsets = hashing.buffers(batch.column(1))
            out = np.zeros(batch.num_rows)
            for first, end, some, at in hashing.pieces(data, offsets):
                row, bucket = features(some, at)
                used = model[bucket] != 0
                pair = np.unique(row[used] << BITS | bucket[used])
                out[first:end] = np.bincount(pair >> BITS, weights=model[pair & (1 << BITS) - 1], minlength=end - first)
            out = 1 / (1 + np.exp(-np.clip(out + model[-1], -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                                     (F.col("score") >= 0.5).cast("int").alias("predicted"))
