"""Token ids of all documents as wavelet matrices: one succinct, compressed row of a Parquet file per shard.

A shard holds the ids of a run of whole documents. Level by level, from the highest bit, it stores
one bit per token (a bit-plane) and goes on with the tokens parted by that bit, zeros first. With
counts of ones per block each plane answers rank and select, so a token at any place, the count of a token
before any place, and all places of a token are found from the planes without decoding the shard.

Documents are range-partitioned by id; each task writes its own shards through Spark's Parquet
writer into the shared folder, so a lost task is written again and nothing passes through the
driver. Where a shard begins in the whole corpus follows from the shards' token counts.

Defined cases: a null text is the empty text; each document ends in END, so an empty one has one
token; rows of equal ids are ordered by a hash of the text and each is a document; a document longer than
SHARD_TOKENS is one longer shard; no rows give no shards. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..workspace import Workspace
from . import hashing
from .common import texts
from .encoder import encoder, tidy

END = 2
SHARD_TOKENS, BLOCK = 2_000_000, 4096
# This stage does little else, so its workers may keep more chunks.
SLOT_BITS = 22
SHARD = "part int, shard int, n_tokens long, bits int, doc_ids binary, doc_tokens binary, planes array<binary>, ranks array<binary>"


class WaveletMatrix:
    """Bit-planes of a sequence of integers below 2**bits, with ranks per block of BLOCK bits."""

    def __init__(self, size: int, planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.size, self.planes, self.ranks = size, planes, ranks
        self.zeros = [size - int(r[-1]) for r in ranks]

    @classmethod
    def build(cls, tokens: np.ndarray, bits: int) -> WaveletMatrix:
        planes, ranks = [], []
        for level in range(bits - 1, -1, -1):
            one = (tokens >> level & 1).astype(bool)
            planes.append(np.packbits(one, bitorder="little"))
            ranks.append(cls._blocks(planes[-1]))
            tokens = np.concatenate([np.compress(~one, tokens), np.compress(one, tokens)])
        return cls(len(tokens), planes, ranks)

    @staticmethod
    def _blocks(plane: np.ndarray) -> np.ndarray:
        """Ones before each block, and in all."""
        step = BLOCK // 8
        counts = np.bitwise_count(plane).astype(np.int64)
        per = np.add.reduceat(counts, np.arange(0, len(counts), step)) if len(counts) else np.zeros(0, np.int64)
        return np.concatenate([[0], np.cumsum(per)]).astype(np.uint32)

    def _ones(self, level: int, end: int) -> int:
        """Ones among the first ``end`` bits of a plane."""
        block, plane = end // BLOCK, self.planes[level]
        part = plane[block * (BLOCK // 8):end // 8]
        rest = int(plane[end // 8]) & ((1 << end % 8) - 1) if end % 8 else 0
        return int(self.ranks[level][block]) + int(np.bitwise_count(part).sum()) + rest.bit_count()

    def access(self, place: int) -> int:
        """The token at a place."""
        token = 0
        for level, plane in enumerate(self.planes):
            bit = int(plane[place // 8]) >> place % 8 & 1
            ones = self._ones(level, place)
            place = self.zeros[level] + ones if bit else place - ones
            token = token * 2 + bit
        return token

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the token's occurrences before ``end`` lie below the last plane."""
        if token >> len(self.planes):
            return 0, 0
        low = 0
        for level in range(len(self.planes)):
            a, b = self._ones(level, low), self._ones(level, end)
            one = token >> len(self.planes) - 1 - level & 1
            low, end = (self.zeros[level] + a, self.zeros[level] + b) if one else (low - a, end - b)
        return low, end

    def rank(self, token: int, end: int) -> int:
        """How often a token occurs before a place."""
        low, high = self._range(token, end)
        return high - low

    def _select(self, level: int, bit: int, which: np.ndarray) -> np.ndarray:
        """Places of the given ones (or zeros) of a plane, counted from 0 and sorted: the directory of
        counts per block names their blocks, and only those are unpacked."""
        before = self.ranks[level].astype(np.int64)
        if not bit:
            before = np.minimum(np.arange(len(before)) * BLOCK, self.size) - before
        block = np.searchsorted(before, which, "right") - 1
        out = np.empty(len(which), np.int64)
        cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(which) else np.zeros(0, np.int64)
        for low, high in zip(cuts.tolist(), np.append(cuts[1:], len(which)).tolist()):
            first = int(block[low]) * BLOCK
            held = self.planes[level][first // 8:(first + BLOCK) // 8]
            bits = np.unpackbits(held, count=min(BLOCK, self.size - first), bitorder="little")
            out[low:high] = first + np.flatnonzero(bits == bit)[which[low:high] - before[block[low]]]
        return out

    def locate(self, token: int) -> np.ndarray:
        """All places of a token, by select through the planes from the last to the first."""
        low, high = self._range(token, self.size)
        places = np.arange(low, high)
        for level in range(len(self.planes) - 1, -1, -1):
            bit = token >> len(self.planes) - 1 - level & 1
            # Places below one plane are in order, and so are their places in the plane above.
            places = self._select(level, bit, places - (self.zeros[level] if bit else 0))
        return places

    def tokens(self) -> np.ndarray:
        """The whole sequence: the planes from the last to the first, each undoing its parting."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        out = np.zeros(self.size, kind)
        for level in range(len(self.planes) - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.size, bitorder="little").astype(bool)
            zeros, back = self.zeros[level], np.empty_like(out)
            back[~one] = out[:zeros]
            back[one] = out[zeros:] | kind(1 << len(self.planes) - 1 - level)
            out = back
        return out


def _open(size: int, planes: list[bytes], ranks: list[bytes]) -> WaveletMatrix:
    return WaveletMatrix(size, [np.frombuffer(p, np.uint8) for p in planes], [np.frombuffer(r, np.uint32) for r in ranks])


def _bits(tokenizer: str, end: int) -> int:
    coder = encoder(tokenizer, slot_bits=SLOT_BITS)
    return max(coder.tokenizer.get_vocab_size(with_added_tokens=True) - 1, end).bit_length()


def encoded(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """doc_id, a hash that orders rows of one id, and the ids with END as integers of two or four bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, kind = encoder(tokenizer, slot_bits=SLOT_BITS), _kind(_bits(tokenizer, end))
        for batch in batches:
            data, offsets = hashing.buffers(batch.column(2))
            for first, stop, some, at in hashing.pieces(data, offsets):
                ids, counts = coder.encode(some, at)
                full = np.insert(ids, np.cumsum(counts), end).astype(kind)
                cuts = np.concatenate([[0], np.cumsum(counts + 1)]) * full.itemsize
                held = pa.Array.from_buffers(pa.large_binary(), stop - first,
                                             [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(full)])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(first, stop - first) for i in range(2)), held.cast(pa.binary())],
                    names=["doc_id", "place", "ids"])
        tidy()

    rows = texts(docs).select("doc_id", F.xxhash64("text").alias("place"), "text")
    return rows.mapInArrow(run, "doc_id long, place long, ids binary")


def _kind(bits: int) -> type:
    return np.uint16 if bits <= 16 else np.uint32


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, ws: Workspace, end: int = END, shard_tokens: int = SHARD_TOKENS) -> None:
    """Write the ids of all documents, in ascending order of documents, as shards in ``folder``.

    Texts are encoded where they are; only ids, half as many bytes, move to their range.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        bits = _bits(tokenizer, end)
        kind = _kind(bits)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        many = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, number, many
            ids, doc_ids, counts = (np.concatenate(x) for x in zip(*held))
            matrix = WaveletMatrix.build(ids, bits)
            row = {"part": part, "shard": number, "n_tokens": matrix.size, "bits": bits, "doc_ids": doc_ids.tobytes(),
                   "doc_tokens": counts.tobytes(), "planes": [p.tobytes() for p in matrix.planes],
                   "ranks": [r.tobytes() for r in matrix.ranks]}
            held, many, number = [], 0, number + 1
            return pa.RecordBatch.from_pylist([row], _SHARD_ARROW)

        for batch in batches:
            raw, offsets = hashing.buffers(batch.column(2))
            # A null id is written as the smallest; the reader turns it back.
            doc_ids = np.asarray(batch.column(0).fill_null(_NO_ID))
            ends = offsets[1:] // kind().itemsize
            ids = np.frombuffer(raw.tobytes(), kind)
            first = 0
            while first < len(ends):
                # As many documents as bring the shard to its size.
                at = int(ends[first - 1]) if first else 0
                stop = min(int(np.searchsorted(ends, at + shard_tokens - many)) + 1, len(ends))
                held.append((ids[at:ends[stop - 1]], doc_ids[first:stop], np.diff(ends[first:stop], prepend=at)))
                many, first = many + int(ends[stop - 1]) - at, stop
                if many >= shard_tokens:
                    yield flush()
        if held:
            yield flush()
        tidy()

    # Staged, as the range shuffle reads its input twice, first for a sample.
    ordered = ws.stage(encoded(docs, tokenizer, end), "ids").repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place")
    ordered.mapInArrow(shards, SHARD).write.option("compression", "zstd").parquet(folder)


_NO_ID = -(1 << 63)
_SHARD_ARROW = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_tokens", pa.int64()), ("bits", pa.int32()),
                          ("doc_ids", pa.binary()), ("doc_tokens", pa.binary()),
                          ("planes", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary()))])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, WaveletMatrix]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            yield row, _open(row["n_tokens"], row["planes"], row["ranks"])


def read_documents(files: DataFrame) -> DataFrame:
    """One row per document, from the files alone: where it starts, its tokens, their checksum."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, matrix in _shards(batches):
            counts = np.frombuffer(row["doc_tokens"], np.int64)
            ends = np.cumsum(counts)
            raw = memoryview(matrix.tokens().astype("<u4").tobytes())
            sums = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(counts), row["part"], np.int32)), pa.array(np.full(len(counts), row["shard"], np.int32)),
                pa.array(ids := np.frombuffer(row["doc_ids"], np.int64), mask=ids == _NO_ID), pa.array(ends - counts),
                pa.array(counts), pa.array(sums, pa.int64())],
                names=["part", "shard", "doc_id", "place", "n_tokens", "ids_crc32"])

    rows = files.mapInArrow(read, "part int, shard int, doc_id long, place long, n_tokens long, ids_crc32 long")
    # One short row per shard: tasks' totals first, so that no window sees more rows than there are tasks.
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = (parts.withColumn("_before", F.sum("total").over(Window.orderBy("part")) - F.col("total")).drop("total"))
    inner = files.select("part", "shard", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard"))
                                           - F.col("n_tokens")).alias("_within"))
    starts = inner.join(before, "part").select("part", "shard", (F.col("_before") + F.col("_within")).alias("_start"))
    return (rows.join(starts, ["part", "shard"])
            .select("doc_id", (F.col("_start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"))


def occurrences(files: DataFrame, token: int) -> DataFrame:
    """Count and places of a token in every shard, by rank and select on the planes."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, matrix in _shards(batches):
            places = matrix.locate(token)
            yield pa.RecordBatch.from_pylist(
                [{"part": row["part"], "shard": row["shard"], "count": matrix.rank(token, matrix.size), "places": places.tolist()}],
                pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("count", pa.int64()), ("places", pa.list_(pa.int64()))]))

    return files.mapInArrow(find, "part int, shard int, count long, places array<long>")


def query(docs: DataFrame, tokenizer: str, ws: Workspace) -> DataFrame:
    folder = ws.path("tokens")
    write_tokens(docs, tokenizer, folder, ws)
    return read_documents(docs.sparkSession.read.parquet(folder))
