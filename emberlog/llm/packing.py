"""Best-fit packing by a configuration linear program over the histogram of lengths.

A configuration is a multiset of lengths that fit one sequence. The program asks for the fewest
configurations that hold every length as often as the corpus has it. Only the histogram (one count
per possible length, whatever the corpus) reaches the driver:

1. Multiplicative weights: a length weighs less the more of its demand is covered. Each round prices
   the lengths by their weights, and an unbounded knapsack by dynamic programming over the capacity
   finds for every length the best configuration that holds it. Those near the best price are
   raised, those of one round together.
2. Rounding: the whole part of each raised configuration is taken, the most raised first, as long as
   the demand allows, and the program is solved again for what is left, until the sequences are within
   TOLERANCE of the dual bound or nothing whole is left to take. The rest goes best-fit decreasing. The
   result never needs more sequences than best-fit alone.

Each piece then finds its sequence by its rank among the pieces of its length. Ranks come from
counts per task and length, so no task sees more than its own pieces.

Defined cases: a null or empty text has the end token only; a document longer than a sequence is
cut into full pieces and a rest; rows of equal ids are documents of their own; no rows give no
sequences. Only ``doc_id`` and ``text`` are read.
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

LENGTH, END = 2048, 0
# Rounds of one solution, how fast weights fall, how close to the best price counts; how near the bound is enough.
ROUNDS, RATE, NEAR, TOLERANCE = 40, 2.0, 0.005, 0.001
_NO_ID = -(1 << 63)


def cut(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, part, and its rank in the part.

    ``rank`` counts the pieces of equal length that the same task (``part``) cut before.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, part = encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(length + 1, np.int64)
        for batch in batches:
            data, offsets = hashing.buffers(batch.column(1))
            doc_ids = np.asarray(batch.column(0).fill_null(_NO_ID))
            for first, stop, some, at in hashing.pieces(data, offsets):
                ids, counts = coder.encode(some, at)
                ids = np.insert(ids, np.cumsum(counts), end).astype("<u4")
                counts = counts + 1
                many = -(-counts // length)
                doc = np.repeat(np.arange(len(counts)), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                size = np.minimum(length, counts[doc] - piece * length)
                ends = np.cumsum(size)
                raw = memoryview(ids.tobytes())
                sums = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip((ends - size).tolist(), ends.tolist())]
                order = np.argsort(size, kind="stable")
                of = size[order]
                start = np.searchsorted(of, of)
                rank = np.empty(len(size), np.int64)
                rank[order] = np.arange(len(of)) - start + seen[of]
                seen += np.bincount(size, minlength=length + 1)
                ids_ = doc_ids[first:stop][doc]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids_, mask=ids_ == _NO_ID), pa.array(piece.astype(np.int32)), pa.array(piece * length),
                    pa.array(size), pa.array(sums, pa.int64()), pa.array(np.full(len(size), part, np.int32)), pa.array(rank)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])
        tidy()

    return texts(docs).mapInArrow(
        pieces, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long")


def _knapsack(price: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Best total price for each capacity, and the length to take first (0: leave the unit empty)."""
    best, first = np.zeros(length + 1), np.zeros(length + 1, np.int64)
    for room in range(1, length + 1):
        gains = price[1:room + 1] + best[room - 1::-1][:room]
        at = int(gains.argmax())
        if gains[at] > best[room - 1]:
            best[room], first[room] = gains[at], at + 1
        else:
            best[room] = best[room - 1]
    return best, first


def _content(first: np.ndarray, room: int) -> list[int]:
    out = []
    while room > 0:
        if first[room]:
            out.append(int(first[room]))
            room -= int(first[room])
        else:
            room -= 1
    return out


def configurations(demand: np.ndarray, tolerance: float = TOLERANCE) -> list[tuple[tuple[int, ...], int]]:
    """Configurations (lengths in descending order) and how often each is used; together they hold
    every length exactly as often as ``demand[length]`` says.

    Solved anew for what rounding left over until the whole is within ``tolerance`` of the program's
    dual bound, or a solution has no configuration that is used once or more.
    """
    length = len(demand) - 1
    demand = demand.astype(np.int64).copy()
    taken: list[tuple[tuple[int, ...], int]] = []
    if demand[length]:
        taken.append(((length,), int(demand[length])))
        demand[length] = 0
    least = -(-int(demand @ np.arange(length + 1)) // length)
    left, kept, best, many = demand, [], _best_fit(demand), None
    while True:
        raised, bound = _raised(left)
        if many is None:
            many, least = 0, max(least, int(np.ceil(bound - 1e-6)))
        used, left = _rounded(left, raised)
        kept += used
        many += sum(n for _, n in used)
        rest = _best_fit(left)
        if many + sum(n for _, n in rest) < sum(n for _, n in best):
            best = kept + rest
        if not used or sum(n for _, n in best) <= (1 + tolerance) * least:
            return taken + best


def _rounded(demand: np.ndarray, raised: list[tuple[tuple[int, ...], float]]) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """The whole part of a solution as far as demand allows, and the demand that is left."""
    left, taken = demand.copy(), []
    for config, times in raised:
        need = np.bincount(config, minlength=len(demand))
        held = np.flatnonzero(need)
        whole = min(int(times + 1e-9), int((left[held] // need[held]).min()))
        if whole > 0:
            left -= need * whole
            taken.append((config, whole))
    return taken, left


def _raised(demand: np.ndarray, rounds: int = ROUNDS) -> tuple[list[tuple[tuple[int, ...], float]], float]:
    """A solution of the covering program in fractions, the most raised configurations first, and its dual bound.

    Configurations not near the best price, which only cover a length for the first time, are left
    out: what they held is solved again.
    """
    length = len(demand) - 1
    wanted = np.flatnonzero(demand)
    if not len(wanted):
        return [], 0.0
    covered, bound = np.zeros(length + 1), 0.0
    raised: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        if (open_ := wanted[covered[wanted] < demand[wanted]]).size == 0:
            break
        share = covered[wanted] / demand[wanted]
        price = np.zeros(length + 1)
        # At equal weights the price of a length is its share of a sequence.
        price[wanted] = wanted / length * np.exp(-RATE * (share - share.min())) * (covered[wanted] < demand[wanted])
        best, first = _knapsack(price, length)
        # Prices by which no configuration is worth more than one are a lower bound of the program.
        bound = max(bound, float(demand @ price) / best[length])
        value = price[open_] + best[length - open_]
        near = (1 - NEAR) * value.max()
        for item, worth in sorted(zip(open_.tolist(), value.tolist()), key=lambda iv: (-price[iv[0]], iv[0])):
            if worth < near and covered[item] > 0:
                continue
            config = tuple(sorted([item, *_content(first, length - item)], reverse=True))
            need = np.bincount(config, minlength=length + 1)
            held = np.flatnonzero(need)
            room = ((demand[held] - covered[held]) / need[held]).min()
            step = max(room / 2, min(1.0, room))
            if step <= 0:
                continue
            covered[held] += need[held] * step
            if worth >= near:
                raised[config] = raised.get(config, 0.0) + step
    return sorted(raised.items(), key=lambda kv: (-kv[1], kv[0])), bound


def _best_fit(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Pack what rounding left, longest first, each into the fullest sequence that has room.

    Sequences of equal content are one entry, so the work follows the number of lengths.
    """
    length = len(left) - 1
    open_: list[dict[tuple[int, ...], int]] = [{} for _ in range(length + 1)]
    for item in range(length, 0, -1):
        many = int(left[item])
        room = item
        while many and room <= length:
            if not open_[room]:
                room += 1
                continue
            config, times = open_[room].popitem()
            used = min(many, times)
            if times > used:
                open_[room][config] = times - used
            after, grown = room - item, (*config, item)
            open_[after][grown] = open_[after].get(grown, 0) + used
            many -= used
            room = item
        while many:
            fits = length // item
            each, many_left = divmod(many, fits)
            if each:
                config, used = (item,) * fits, each
                many = many_left
            else:
                config, used, many = (item,) * many, 1, 0
            room_left = length - item * len(config)
            open_[room_left][config] = open_[room_left].get(config, 0) + used
    return [(c, n) for by in open_ for c, n in by.items()]


def _places(configs: list[tuple[tuple[int, ...], int]], length: int) -> dict[str, np.ndarray]:
    """Look-up by (length, rank): rows sorted by length and first rank."""
    rows, base, seen = [], 0, np.zeros(length + 1, np.int64)
    for config, times in configs:
        offset = 0
        for item in config:
            rows.append((item, int(seen[item]), base, offset))
            seen[item] += times
            offset += item
        base += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack(pieces: DataFrame, ws: Workspace, length: int = LENGTH) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to staged pieces (columns length, part, rank).

    The look-up that every task gets has a row for each item of each configuration: its size
    follows the sequence length, not the corpus.
    """
    spark = pieces.sparkSession
    counts = ws.stage(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths", measure=True)
    demand = np.zeros(length + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        demand[row.length] = row.n
    table = _places(configurations(demand), length)
    before = counts.select("length", "part", (F.sum("n").over(
        Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("_before"))
    ranked = pieces.join(before, ["length", "part"]).withColumn("_rank", F.col("_before") + F.col("rank"))
    held = spark.sparkContext.broadcast(table)
    names = [c for c in pieces.columns if c not in ("part", "rank")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = held.value
        # One key for (length, rank): ranks of all lengths before, plus the rank.
        for batch in batches:
            size, rank = np.asarray(batch.column("length")), np.asarray(batch.column("_rank"))
            low, high = np.searchsorted(t["length"], size, "left"), np.searchsorted(t["length"], size, "right")
            while (open_ := high - low > 1).any():
                middle = (low + high) // 2
                up = t["rank"][np.minimum(middle, len(t["rank"]) - 1)] <= rank
                low, high = np.where(open_ & up, middle, low), np.where(open_ & ~up, middle, high)
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(t["sequence"][low] + rank - t["rank"][low]), pa.array(t["offset"][low])],
                names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.select(*names).schema.fields)
    return ranked.select(*names, "_rank").mapInArrow(place, f"{schema}, sequence_id long, offset long")


def query(docs: DataFrame, tokenizer: str, ws: Workspace) -> DataFrame:
    return pack(ws.stage(cut(docs, tokenizer), "pieces"), ws)
