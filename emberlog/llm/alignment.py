"""Alignment of the tokens of two tokenizers by divide and conquer at shared cuts.

Both tokenizers spell one byte string, a space and the text: A is a byte-level BPE of the tokenizers
library, B a SentencePiece BPE. An interval of tokens that begins and ends at one byte in both is
halved: from the middle token of A outward, token ends are looked up among B's by bisection until
one is an end there too; both sides of that cut are intervals again. An interval without a cut is
a leaf, the smallest group of tokens that spell the same bytes. All open intervals of a buffer of
texts advance together, so a level of the recursion is a few array operations. An interval that
has not found a cut near its middle after PROBES steps looks at all of its ends at once.

At each cut one token of A and one of B end together: a link. Links are counted for the whole corpus by
pair of ids (folded in every task before they move). The table of pairs has at most one row per pair of
vocabulary entries, not per document; it is handed to tasks in blocks of at most PAIR_ROWS rows, by
hash, one block after the other, so no executor holds more than one block however many pairs there are.

Defined cases: a null or empty text has no tokens; nor has a text that one of the two does not spell
byte for byte (U+2581, which B writes for a space); strings of control tokens are plain text; rows of
equal ids are documents of their own; no rows give no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..workspace import Workspace
from . import hashing, pieces
from .encoder import ChunkTable, Encoder, tidy

PROBES = 16
PAIR_ROWS = 2_000_000
# Links that a task folds before it passes their counts on.
FOLD_LINKS = 1 << 21


class PieceBpe(ChunkTable):
    """Ids of the sentencepiece library. Every row begins with the space that the library puts in front."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.spoken = pieces.load(path).spoken
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        # What the library puts before a chunk that follows a line feed, as no piece lies across one.
        self.lead = len(self.model.encode("\n"))

    def cuts(self, data: np.ndarray) -> np.ndarray:
        return pieces.cuts(data)

    def whole(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows that spell the sign for a space: it could join a space across a cut."""
        rows = np.zeros(len(offsets) - 1, bool)
        if len(data) > 2:
            sign = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))
            rows[np.searchsorted(offsets, sign, "right") - 1] = True
        return rows

    def encode_chunks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.model.encode(["\n" + t for t in texts], num_threads=1)
        counts = np.array([len(f) for f in found]) - self.lead
        ids = np.fromiter(chain.from_iterable(f[self.lead:] for f in found), np.uint32, int(counts.sum()))
        return ids, counts

    def encode_whole(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text[1:]), np.uint32)


class _Spoken:
    """The bytes that the ids of a vocabulary stand for."""

    def __init__(self, spoken: list[bytes]):
        self.size = np.array([len(s) for s in spoken], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(spoken), np.uint8)

    def join(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        end = np.cumsum(size)
        return self.data[np.repeat(self.start[ids] - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)]


def _letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves,
    the others for the letters from U+0100 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def _byte_tokens(coder: Encoder) -> list[bytes]:
    letters = _letters()
    out = [b""] * coder.tokenizer.get_vocab_size(with_added_tokens=True)
    for token, number in coder.tokenizer.get_vocab(with_added_tokens=False).items():
        if all(c in letters for c in token):
            out[number] = bytes(letters[c] for c in token)
    return out


@dataclass
class Aligned:
    """Tokens of a buffer of texts: ids and counts per row of both sides, and the cuts, as the places of
    the tokens that end there, in order."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_counts: np.ndarray
    b_counts: np.ndarray
    a_cuts: np.ndarray
    b_cuts: np.ndarray


class Aligner:
    def __init__(self, byte_bpe: str, piece_bpe: str):
        self.a, self.b = Encoder(byte_bpe, plain=True), PieceBpe(piece_bpe)
        self.a_spoken, self.b_spoken = _Spoken(_byte_tokens(self.a)), _Spoken(self.b.spoken)

    def align(self, data: np.ndarray, offsets: np.ndarray) -> Aligned:
        """Both sides' tokens of UTF-8 rows, and where they end together."""
        filled = np.diff(offsets) > 0
        spaced = np.insert(data, offsets[:-1][filled], 32)
        offsets = offsets + np.concatenate([[0], np.cumsum(filled)])
        a_ids, a_counts = self.a.encode(spaced, offsets)
        b_ids, b_counts = self.b.encode(spaced, offsets)
        good = self._spelled(spaced, offsets, self.a_spoken, a_ids, a_counts)
        good &= self._spelled(spaced, offsets, self.b_spoken, b_ids, b_counts)
        if not good.all():
            a_ids, b_ids = a_ids[np.repeat(good, a_counts)], b_ids[np.repeat(good, b_counts)]
            a_counts, b_counts = a_counts * good, b_counts * good
        a_cuts, b_cuts = common_ends(np.cumsum(self.a_spoken.size[a_ids]), np.cumsum(self.b_spoken.size[b_ids]), a_counts, b_counts)
        return Aligned(a_ids, b_ids, a_counts, b_counts, a_cuts, b_cuts)

    @staticmethod
    def _spelled(data, offsets, spoken: _Spoken, ids, counts) -> np.ndarray:
        """Rows whose ids spell their bytes."""
        joined = spoken.join(ids)
        if len(joined) == len(data) and (joined == data).all():
            return np.ones(len(counts), bool)
        size = np.concatenate([[0], np.cumsum(spoken.size[ids])])[np.concatenate([[0], np.cumsum(counts)])]
        return np.array([np.array_equal(joined[a:b], data[c:d])
                         for a, b, c, d in zip(size, size[1:], offsets, offsets[1:])], bool)


def common_ends(a_end: np.ndarray, b_end: np.ndarray, a_counts: np.ndarray, b_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens of both sides that end at one byte, in order.

    ``a_end`` and ``b_end`` are the ends of the tokens of all rows in a row; a row's last tokens end together.
    """
    rows = np.flatnonzero(a_counts)
    a1, b1 = np.cumsum(a_counts)[rows], np.cumsum(b_counts)[rows]
    a0, b0 = a1 - a_counts[rows], b1 - b_counts[rows]
    found = [(a1 - 1, b1 - 1)]
    tried = np.zeros(len(a0), np.int64)
    while True:
        # A cut inside needs two tokens on both sides.
        open_ = np.flatnonzero((a1 - a0 > 1) & (b1 - b0 > 1) & (tried < a1 - a0 - 1))
        if not len(open_):
            break
        a0, a1, b0, b1, tried = a0[open_], a1[open_], b0[open_], b1[open_], tried[open_]
        inner, middle = a1 - a0 - 1, (a1 - a0 - 1) // 2
        # The middle, one after it, one before it, and so on; beyond one side only the other is left.
        step = (tried + 1) // 2
        near = np.where(tried % 2 == 1, middle + step, middle - step)
        near = np.where(tried > 2 * np.minimum(middle, inner - 1 - middle), np.where(middle > inner - 1 - middle, inner - 1 - tried, tried), near)
        at = a0 + near
        place = np.searchsorted(b_end, a_end[at])
        hit = b_end[place] == a_end[at]
        late = np.flatnonzero(~hit & (tried >= PROBES))
        for i in late.tolist():
            # All ends of a long interval that has none near its middle, the nearest first.
            ends = np.searchsorted(b_end, a_end[a0[i]:a1[i] - 1])
            same = np.flatnonzero(b_end[ends] == a_end[a0[i]:a1[i] - 1])
            if len(same):
                one = same[np.abs(same - middle[i]).argmin()]
                at[i], place[i], hit[i] = a0[i] + one, ends[one], True
            else:
                tried[i] = inner[i]
        cut, rest = np.flatnonzero(hit), np.flatnonzero(~hit)
        found.append((at[cut], place[cut]))
        both = lambda first, second, third: np.concatenate([first, second, third])
        a0, a1, b0, b1, tried = (both(a0[rest], a0[cut], at[cut] + 1), both(a1[rest], at[cut] + 1, a1[cut]),
                                 both(b0[rest], b0[cut], place[cut] + 1), both(b1[rest], place[cut] + 1, b1[cut]),
                                 both(tried[rest] + 1, np.zeros(len(cut), np.int64), np.zeros(len(cut), np.int64)))
    a_cuts, b_cuts = (np.sort(np.concatenate(x)) for x in zip(*found))
    return a_cuts, b_cuts


@lru_cache(maxsize=1)
def _aligner(byte_bpe: str, piece_bpe: str) -> Aligner:
    """One per Python worker, so that its tables outlive a task."""
    return Aligner(byte_bpe, piece_bpe)


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def aligned(docs: DataFrame, byte_bpe: str, piece_bpe: str) -> DataFrame:
    """One row per document: doc_id, the ids of both sides, and how many tokens each group has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _aligner(byte_bpe, piece_bpe)
        for batch in batches:
            data, offsets = hashing.buffers(batch.column(1))
            for first, stop, some, at in hashing.pieces(data, offsets):
                got = tool.align(some, at)
                ends = np.cumsum(got.a_counts)
                cuts = np.searchsorted(got.a_cuts, ends)
                listed = lambda counts, values: pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], counts]).astype(np.int32)), pa.array(values.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, stop - first), listed(ends, got.a_ids), listed(np.cumsum(got.b_counts), got.b_ids),
                     listed(cuts, np.diff(got.a_cuts, prepend=-1)), listed(cuts, np.diff(got.b_cuts, prepend=-1))],
                    names=["doc_id", "a_ids", "b_ids", "a_sizes", "b_sizes"])
        tidy()

    return _documents(docs).mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>")


@lru_cache(maxsize=1)
def _decimals(most: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of 0..most-1, one row each with a place for a sign behind them, and their number."""
    width = len(str(most - 1))
    rows = np.zeros((most, width + 1), np.uint8)
    size = np.array([len(str(i)) for i in range(most)], np.int64)
    for n in range(1, width + 1):
        of = np.flatnonzero(size == n)
        rows[of, :n] = np.frombuffer("".join(str(i) for i in of).encode(), np.uint8).reshape(len(of), n)
    return rows, size


def _written(got: Aligned, most: int) -> tuple[bytes, np.ndarray]:
    """Groups of all rows as ``a1,a2|b1;a3|b2,b3;`` and where each row ends."""
    rows, width = _decimals(most)
    a_group = np.searchsorted(got.a_cuts, np.arange(len(got.a_ids)))
    b_group = np.searchsorted(got.b_cuts, np.arange(len(got.b_ids)))
    # A group's tokens of A come first, then those of B.
    before_b = np.concatenate([[-1], got.b_cuts]) + 1
    a_place = np.arange(len(got.a_ids)) + before_b[a_group]
    b_place = np.arange(len(got.b_ids)) + got.a_cuts[b_group] + 1 if len(got.b_ids) else np.zeros(0, np.int64)
    ids, sign = np.empty(len(a_place) + len(b_place), np.int64), np.full(len(a_place) + len(b_place), ord(","), np.uint8)
    ids[a_place], ids[b_place] = got.a_ids, got.b_ids
    sign[a_place[got.a_cuts]], sign[b_place[got.b_cuts]] = ord("|"), ord(";")
    size = width[ids]
    held = rows[ids]
    held[np.arange(len(ids)), size] = sign
    out = held[np.arange(held.shape[1]) <= size[:, None]]
    ends = np.concatenate([[0], np.cumsum(size + 1)])[np.cumsum(got.a_counts + got.b_counts)]
    return out.tobytes(), ends


_HEAD = "part int, row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string"


def described(docs: DataFrame, byte_bpe: str, piece_bpe: str) -> DataFrame:
    """One row per document: its numbers, the digest of its groups, and its links as packed pairs of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tool, part, number = _aligner(byte_bpe, piece_bpe), TaskContext.get().partitionId(), 0
        a_most, b_most = len(tool.a_spoken.size), len(tool.b_spoken.size)
        kind = pair_kind(a_most, b_most)
        for batch in batches:
            data, offsets = hashing.buffers(batch.column(1))
            for first, stop, some, at in hashing.pieces(data, offsets):
                got, n = tool.align(some, at), stop - first
                text, ends = _written(got, max(a_most, b_most))
                low = np.concatenate([[0], ends])
                digests = [hashlib.sha256(text[a:b - 1]).hexdigest() if b > a else "" for a, b in zip(low.tolist(), ends.tolist())]
                pairs = (got.a_ids[got.a_cuts].astype(kind) * kind(b_most) + got.b_ids[got.b_cuts].astype(kind)).astype(kind)
                cuts = np.searchsorted(got.a_cuts, np.cumsum(got.a_counts))
                links = pa.Array.from_buffers(pa.binary(), n, [
                    None, pa.py_buffer((np.concatenate([[0], cuts]) * pairs.itemsize).astype(np.int32)), pa.py_buffer(pairs)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(number, number + n)), batch.column(0).slice(first, n),
                     pa.array(got.a_counts), pa.array(got.b_counts), pa.array(np.diff(cuts, prepend=0)), pa.array(digests), links],
                    names=["part", "row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])
                number += n
        tidy()

    return _documents(docs).mapInArrow(run, f"{_HEAD}, links binary")


def pair_kind(a_most: int, b_most: int) -> type:
    return np.uint32 if a_most * b_most < 1 << 32 else np.uint64


def pair_counts(rows: DataFrame, a_most: int, b_most: int) -> DataFrame:
    """One row per linked pair of ids: a, b, how many links hold it, and whether no pair of its b has more.

    This is the map between the vocabularies that the corpus implies.
    """
    kind = pair_kind(a_most, b_most)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0

        def out() -> pa.RecordBatch:
            keys, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            n = np.bincount(back, weights=np.concatenate([n for _, n in held]), minlength=len(keys)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], names=["pair", "n"])

        for batch in batches:
            keys, n = np.unique(np.frombuffer(hashing.buffers(batch.column(0))[0].tobytes(), kind), return_counts=True)
            held.append((keys, n))
            many += len(keys)
            if many > FOLD_LINKS:
                yield out()
                held, many = [], 0
        if many:
            yield out()
        tidy()

    counts = rows.select("links").mapInArrow(fold, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = counts.select(F.floor(F.col("pair") / b_most).alias("a"), F.pmod("pair", F.lit(b_most)).alias("b"), "pair", "n")
    # At most one row per entry of A's vocabulary in a window.
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def _summed(rows: DataFrame, block: DataFrame, kind: type) -> DataFrame:
    """Links of each document that ``block``, a bounded part of the pairs, knows: number that are best, sum of counts."""
    table = block.select("pair", "n", "best").toArrow().sort_by("pair")
    held = rows.sparkSession.sparkContext.broadcast(
        (np.asarray(table["pair"]).astype(kind), np.asarray(table["n"]), np.asarray(table["best"]).astype(bool)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = held.value
        for batch in batches:
            raw, offsets = hashing.buffers(batch.column("links"))
            links = np.frombuffer(raw.tobytes(), kind)
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets) // links.itemsize)
            total, good = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, links), len(keys) - 1)
                known = keys[at] == links
                np.add.at(total, row[known], n[at[known]])
                good = np.bincount(row[known], weights=best[at[known]], minlength=batch.num_rows).astype(np.int64)
            columns = [batch.column(c) for c in batch.schema.names if c != "links"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(good), pa.array(total)],
                                             names=[*(c for c in batch.schema.names if c != "links"), "n_best", "count_sum"])
        tidy()

    return rows.mapInArrow(look, f"{_HEAD}, n_best long, count_sum long")


def query(docs: DataFrame, byte_bpe: str, piece_bpe: str, ws: Workspace) -> DataFrame:
    tool = Aligner(byte_bpe, piece_bpe)
    a_most, b_most = len(tool.a_spoken.size), len(tool.b_spoken.size)
    rows = ws.stage(described(docs, byte_bpe, piece_bpe), "described")
    pairs = ws.stage(pair_counts(rows, a_most, b_most), "pairs", measure=True)
    blocks = max(1, -(-pairs._emberlog_size[0] // PAIR_ROWS))
    kind = pair_kind(a_most, b_most)
    if blocks == 1:
        out = _summed(rows, pairs, kind)
    else:
        # Twice as many blocks as would do, as a hash does not deal them evenly.
        blocks *= 2
        own = F.pmod(F.xxhash64("pair"), F.lit(blocks))
        found = [ws.stage(_summed(rows, pairs.filter(own == i), kind), "sums") for i in range(blocks)]
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        out = out.groupBy("part", "row").agg(*[F.first(c).alias(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")],
                                             F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    # Each cut ends one token of either side, so a group holds one link.
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
