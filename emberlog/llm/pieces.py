"""SentencePiece encoding by a batched Viterbi over the pieces of a model file, and decoding.

A text gets a space in front and spaces become U+2581, as identity-normalising models do it. It is
cut where no piece can lie across (before a run of spaces, around line feeds). Different chunks
that are not in the worker's table are grouped by length, and all chunks of one length advance
together: for each end position the substrings of every piece length are hashed, probed in the
sorted keys of the pieces of that length, and the best sum of scores per chunk is one vectorised
maximum that leaves a backpointer. A character no piece holds is written as its UTF-8 bytes.

The segmentation is the one of the highest total score; among equals the last piece is the longest.
For a model trained as unigram that is the library's own; a BPE model's merges follow another
order, so ids differ from it where a greedy merge is not the best sum.

Defined cases: a null text is the empty text and has no ids; repeated rows are encoded each; decoding
gives every text back exactly, but that U+2581 itself comes back as a space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import hashing
from .encoder import ChunkTable, tidy

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
# Characters that one step of the batch looks at.
STEP_CHARS = 1 << 18
_MULTIPLIER = np.uint64(hashing.BASE)


@dataclass(frozen=True)
class Model:
    """Pieces with their scores; ids of the 256 byte pieces; what decoding writes for each id."""

    pieces: list[str]
    scores: list[float]
    bytes_: list[int]
    spoken: list[bytes]


def load(path: str) -> Model:
    """Read a model file. The driver does it once; tasks get the tables."""
    import sentencepiece

    held = sentencepiece.SentencePieceProcessor(model_file=path)
    if held.normalize(" a  bÅﬁ") != SPACE + SPACE + "a" + 2 * SPACE + "bÅﬁ":
        raise ValueError("only models that keep texts as they are can be used")
    n = held.get_piece_size()
    known = [i for i in range(n) if not (held.is_unknown(i) or held.is_control(i) or held.is_byte(i) or held.is_unused(i))]
    pieces, scores, spoken, raw = [""] * n, [0.0] * n, [b""] * n, [-1] * 256
    for i in known:
        pieces[i], scores[i] = held.id_to_piece(i), held.get_score(i)
        spoken[i] = pieces[i].replace(SPACE, " ").encode()
    for i in range(n):
        if held.is_byte(i):
            value = int(held.id_to_piece(i)[3:5], 16)
            raw[value], spoken[i] = i, bytes([value])
    if min(raw) < 0:
        raise ValueError("the model has no byte pieces")
    if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces):
        raise ValueError("a piece lies across a cut")
    return Model(pieces, scores, raw, spoken)


def _keys(points: np.ndarray) -> np.ndarray:
    """Hashes of the rows of a matrix of code points."""
    out = np.zeros(len(points), np.uint64)
    for i in range(points.shape[1]):
        out = out * _MULTIPLIER + points[:, i]
    return out


def _points(texts: list[str], length: int) -> np.ndarray:
    """Code points of texts of one length, one row each."""
    raw = "".join(texts).encode("utf-32-le")
    return np.frombuffer(raw, np.uint32).reshape(len(texts), length).astype(np.uint64) + np.uint64(1)


def cuts(data: np.ndarray) -> np.ndarray:
    """Where no piece lies across: before a run of spaces, before and after a line feed."""
    space, feed = data == 32, data == 10
    first = space | feed
    first[1:] &= ~(space[:-1] & space[1:])
    first[1:] |= feed[:-1]
    return first


class PieceEncoder(ChunkTable):
    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.keys_of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        by: dict[int, list[int]] = {}
        for i, piece in enumerate(model.pieces):
            if piece:
                by.setdefault(len(piece), []).append(i)
        for length, ids in by.items():
            keys = _keys(_points([model.pieces[i] for i in ids], length))
            order = np.argsort(keys)
            if (np.diff(keys[order]) == 0).any():
                raise ValueError("two pieces have one hash")
            held = np.array(ids)[order]
            self.keys_of[length] = (keys[order], held, np.array(model.scores)[held])
        normal = [s for p, s in zip(model.pieces, model.scores) if p]
        self.unknown = min(normal, default=0.0) - UNKNOWN_PENALTY
        self.longest = max(self.keys_of, default=1)
        self.spoken = np.frombuffer(b"".join(model.spoken), np.uint8)
        self.spoken_size = np.array([len(b) for b in model.spoken])
        self.spoken_at = np.cumsum(self.spoken_size) - self.spoken_size

    def cuts(self, data: np.ndarray) -> np.ndarray:
        return cuts(data)

    def encode_chunks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        texts = [t.replace(" ", SPACE) for t in texts]
        size = np.array([len(t) for t in texts])
        rows, ends, ids = [], [], []
        for length in np.unique(size):
            of = np.flatnonzero(size == length)
            step = max(1, STEP_CHARS // int(length))
            for i in range(0, len(of), step):
                some = of[i:i + step]
                row, end, id_ = self._viterbi(_points([texts[k] for k in some], int(length)))
                rows.append(some[row])
                ends.append(end)
                ids.append(id_)
        row, end, id_ = np.concatenate(rows), np.concatenate(ends), np.concatenate(ids)
        order = np.lexsort((end, row))
        row, end, id_ = row[order], end[order], id_[order]
        lost = np.flatnonzero(id_ < 0)
        if len(lost):
            spelled = [texts[r][e - 1].encode() for r, e in zip(row[lost].tolist(), end[lost].tolist())]
            many = np.ones(len(id_), np.int64)
            many[lost] = [len(b) for b in spelled]
            row = np.repeat(row, many)
            at = np.flatnonzero(np.repeat(id_ < 0, many))
            id_ = np.repeat(id_, many)
            id_[at] = np.array(self.model.bytes_)[np.frombuffer(b"".join(spelled), np.uint8)]
        return id_.astype(np.uint32), np.bincount(row, minlength=len(texts))

    def _viterbi(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best segmentation of rows of one length: (row, end, id) of all pieces, id -1 for unknown."""
        m, length = points.shape
        best = np.full((m, length + 1), -np.inf)
        best[:, 0] = 0
        taken = np.zeros((m, length + 1), np.uint8)
        chosen = np.full((m, length + 1), -1, np.int32)
        section = max(1, STEP_CHARS // m)
        for low in range(0, length, section):
            high = min(length, low + section)
            # Substrings that end in this section, by their length.
            begin = max(0, low - self.longest + 1)
            part, hashed, found = points[:, begin:high], None, []
            for size in range(1, min(self.longest, high) + 1):
                width = part.shape[1] - size + 1
                if width <= 0:
                    break
                hashed = part.copy() if hashed is None else hashed[:, :width] * _MULTIPLIER + part[:, size - 1:]
                if size not in self.keys_of:
                    continue
                keys, ids, scores = self.keys_of[size]
                at = np.minimum(np.searchsorted(keys, hashed.ravel()), len(keys) - 1).reshape(hashed.shape)
                hit = keys[at] == hashed
                if hit.any():
                    found.append((size, np.where(hit, scores[at], -np.inf), ids[at], hit.any(0)))
            for end in range(low + 1, high + 1):
                top, one, what = np.full(m, -np.inf), np.zeros(m, np.uint8), np.full(m, -1, np.int32)
                known = np.zeros(m, bool)
                for size, score, ids, any_ in found:
                    place = end - size - begin
                    if place < 0 or not any_[place]:
                        continue
                    total = best[:, end - size] + score[:, place]
                    if size == 1:
                        known = score[:, place] > -np.inf
                    better = (total >= top) & (total > -np.inf)
                    top = np.where(better, total, top)
                    one = np.where(better, np.uint8(size), one)
                    what = np.where(better, ids[:, place], what)
                total = np.where(known, -np.inf, best[:, end - 1] + self.unknown)
                lost = total > top
                best[:, end] = np.where(lost, total, top)
                taken[:, end] = np.where(lost, 1, one)
                chosen[:, end] = np.where(lost, -1, what)
        rows, ends, ids = [], [], []
        row, end = np.arange(m), np.full(m, length)
        while len(row):
            rows.append(row)
            ends.append(end)
            ids.append(chosen[row, end])
            end = end - taken[row, end]
            row, end = row[end > 0], end[end > 0]
        return np.concatenate(rows), np.concatenate(ends), np.concatenate(ids)

    def encode_texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of UTF-8 rows, each with a space put in front, and how many each row has."""
        filled = np.diff(offsets) > 0
        spaced = np.insert(data, offsets[:-1][filled], 32)
        return self.encode(spaced, offsets + np.concatenate([[0], np.cumsum(filled)]))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """What the ids of each row spell, without the space put in front."""
        size = self.spoken_size[ids]
        ends = np.cumsum(size)
        out = self.spoken[np.repeat(self.spoken_at[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        cut = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [out[a + (out[a:a + 1] == b" "):b] if b > a else b"" for a, b in zip(cut, cut[1:])]


_made: dict[int, PieceEncoder] = {}


def encode(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, ids, and the text that decoding the ids gives."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = held.id if hasattr(held, "id") else id(held.value)
        if key not in _made:
            _made.clear()
            _made[key] = PieceEncoder(held.value)
        coder = _made[key]
        for batch in batches:
            data, offsets = hashing.buffers(batch.column(1))
            for first, end, part, at in hashing.pieces(data, offsets):
                ids, counts = coder.encode_texts(part, at)
                back = [b.decode("utf-8", "replace") for b in coder.decode(ids, counts)]
                cuts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first),
                     pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids.astype(np.int32))), pa.array(back, pa.string())],
                    names=["doc_id", "ids", "decoded"])
        tidy()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def query(docs: DataFrame, path: str) -> DataFrame:
    """Ids, their number, and the hash of the decoded text, for every document."""
    coded = encode(docs, load(path))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                        F.length("decoded").cast("long").alias("decoded_chars"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
