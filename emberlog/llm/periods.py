"""Periodic runs in the words of a text, by longest common extensions on suffix trees.

A run is a stretch of words with smallest period q that no neighbouring word extends and that holds at
least ``exponent`` periods and ``least`` words.

1. Ukkonen's algorithm builds the suffix trees of a stretch of words and of its reversal.
2. An Euler tour of each tree, with minima per block and a sparse table over blocks, gives the least depth
   between two leaves, and so the longest common extension of two places, in constant time.
3. The longest Lyndon word at every place, for the order of the words and for the reverse order, is a
   candidate root. Both sides of a root are extended by the two trees; roots that reach far enough are
   runs, and every run has such a root.

Trees are built for stretches that can hold a run, with a word to spare on either side. In a run of
period q every three words in a row (fewer, if runs may be short) come again within q words, as long as
they and a period are left. So for each power of two D all stretches of words that come again within D and are long
enough for the periods from D/2 to D are taken, and stretches that meet are joined; the rest of a text
holds no run. Memory follows the longest such stretch (some 500 bytes a word).

Defined cases: words are runs without white space; a null or empty text has no words and no runs; rows of
equal ids are texts of their own; a null id marks no edited text; no rows give no rows. Only ``doc_id``
and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import hashing
from .encoder import tidy

LEAST, EXPONENT = 6, 4
BLOCK = 32


class SuffixTree:
    """The suffix tree of a sequence of positive integers, with constant-time longest common extensions."""

    def __init__(self, sequence: list[int]):
        self.size = len(sequence)
        # The end mark, less than all others, makes every suffix a leaf.
        self._build([*sequence, 0])
        self._tour()

    def _build(self, s: list[int]) -> None:
        """Ukkonen: one symbol after the other; the active point is (node, place of an edge's first symbol, length)."""
        n, width = len(s), max(s) + 1
        start, end, link = [0], [0], [0]
        edges: dict[int, int] = {}
        node = place = length = pending = 0
        for i, symbol in enumerate(s):
            waits = 0
            pending += 1
            while pending:
                if not length:
                    place = i
                key = node * width + s[place]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if waits:
                        link[waits] = node
                        waits = 0
                else:
                    first = start[child]
                    span = end[child] - first
                    if length >= span:
                        node = child
                        place += span
                        length -= span
                        continue
                    if s[first + length] == symbol:
                        length += 1
                        if waits:
                            link[waits] = node
                        break
                    inner = len(start)
                    edges[key] = inner
                    start += (first, i)
                    end += (first + length, n)
                    link += (0, 0)
                    edges[inner * width + symbol] = inner + 1
                    start[child] = first + length
                    edges[inner * width + s[first + length]] = child
                    if waits:
                        link[waits] = inner
                    waits = inner
                pending -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    place = i - pending + 1
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        order = np.argsort(keys)
        self._kids = np.fromiter(edges.values(), np.int64, len(edges))[order].tolist()
        parent = keys[order] // width
        nodes = np.arange(len(start))
        self._low = np.searchsorted(parent, nodes, "left").tolist()
        self._high = np.searchsorted(parent, nodes, "right").tolist()
        self._span = (np.array(end) - np.array(start)).tolist()
        # Nodes whose first child is the end mark.
        self._ends = np.zeros(len(start), bool)
        self._ends[parent[keys[order] % width == 0]] = True

    def _tour(self) -> None:
        """Depths along the Euler tour, where each leaf comes first, and the suffixes in order."""
        kids, low, high, span, n = self._kids, self._low, self._high, self._span, self.size + 1
        depth, tour, first, suffixes = [0] * len(low), [0], [0] * n, []
        at, stack, node, deep = list(low), [], 0, 0
        while True:
            k = at[node]
            if k < high[node]:
                at[node] = k + 1
                child = kids[k]
                reach = deep + span[child]
                depth[child] = reach
                if low[child] == high[child]:
                    first[n - reach] = len(tour)
                    suffixes.append(n - reach)
                    tour += (reach, deep)
                else:
                    tour.append(reach)
                    stack.append(node)
                    node, deep = child, reach
            elif stack:
                node = stack.pop()
                deep = depth[node]
                tour.append(deep)
            else:
                break
        self._depth, self._first = depth, np.array(first)
        self.suffixes = suffixes
        blocks = -(-len(tour) // BLOCK)
        held = np.full(blocks * BLOCK, n, np.int32)
        held[:len(tour)] = tour
        self._held = held.reshape(blocks, BLOCK)
        self._before = np.minimum.accumulate(self._held, 1).ravel()
        self._after = np.minimum.accumulate(self._held[:, ::-1], 1)[:, ::-1].ravel()
        self._table = [self._held.min(1)]
        while 1 << len(self._table) <= blocks:
            half = 1 << len(self._table) - 1
            self._table.append(np.minimum(self._table[-1][:-half], self._table[-1][half:]))

    def reverse_order(self) -> list[int]:
        """The suffixes in order when the order of the symbols is turned round, the end mark still the least."""
        kids, low, high, depth, n, out = self._kids, self._low, self._high, self._depth, self.size + 1, []
        ends, stack = self._ends.tolist(), [0]
        while stack:
            node = stack.pop()
            a, b = low[node], high[node]
            if a == b:
                out.append(n - depth[node])
            elif ends[node]:
                stack += kids[a + 1:b]
                stack.append(kids[a])
            else:
                stack += kids[a:b]
        return out

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from the different places i and j on are equal."""
        a, b = self._first[i], self._first[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        x, y = a // BLOCK, b // BLOCK
        out = np.minimum(self._after[a], self._before[b]).astype(np.int64)
        one = np.flatnonzero(x == y)
        for some in np.array_split(one, -(-len(one) // 65536)) if len(one) else ():
            inside = np.arange(BLOCK)
            held = self._held[x[some]]
            out[some] = np.where((inside >= (a[some] % BLOCK)[:, None]) & (inside <= (b[some] % BLOCK)[:, None]), held, self.size + 1).min(1)
        far = np.flatnonzero(y - x > 1)
        if len(far):
            low, high = x[far] + 1, y[far]
            level = np.frexp(high - low)[1] - 1
            for k in np.unique(level).tolist():
                of = np.flatnonzero(level == k)
                row = self._table[k]
                out[far[of]] = np.minimum(out[far[of]], np.minimum(row[low[of]], row[high[of] - (1 << k)]))
        return out


def _next_smaller(suffixes: list[int]) -> np.ndarray:
    """For each place the next one whose suffix is less, from the suffixes in order (the empty one first)."""
    n = len(suffixes) - 1
    rank = np.empty(n + 1, np.int64)
    rank[suffixes] = np.arange(n + 1)
    rank, out = rank.tolist(), [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        own, j = rank[i], i + 1
        while rank[j] > own:
            j = out[j]
        out[i] = j
    return np.array(out[:n], np.int64)


def find_runs(sequence: list[int], least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """All runs of a sequence of positive integers as rows (start, length, period), by start and period."""
    n = len(sequence)
    if n < max(2, least):
        return np.zeros((0, 3), np.int64)
    ahead, back = SuffixTree(sequence), SuffixTree(sequence[::-1])
    place, found = np.arange(n), []
    for suffixes in (ahead.suffixes, ahead.reverse_order()):
        after = _next_smaller(suffixes)
        period = after - place
        right = ahead.extension(place, after)
        # What ends before a place is what begins behind its mirror image.
        left = back.extension(n - place, n - after)
        length = left + period + right
        good = np.flatnonzero((length >= np.maximum(least, exponent * period)) & (length >= 2 * period))
        found.append(np.stack([place[good] - left[good], length[good], period[good]], 1))
    runs = np.unique(np.concatenate(found), axis=0)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _needed(low: int, high: int, least: int, exponent: int) -> int:
    """How many words in a row come again one period later in any run with a period from low to high."""
    turn = -(-least // exponent)
    return min(max(least, exponent * q) - q for q in {low, high, min(max(turn, low), high), min(max(turn - 1, low), high)})


def stretches(words: np.ndarray, row: np.ndarray, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches [from, to) of words, given by hash and row, outside which no run lies; none crosses rows."""
    none = np.zeros(0, np.int64)
    # So many words in a row are compared, one place of which any run has.
    gram = min(3, _needed(1, 1 << 62, least, exponent))
    if len(words) < gram:
        return none, none
    n = len(words) - gram + 1
    key = row[:n].astype(np.uint64)
    for i in range(gram):
        key = hashing.mixed(key * np.uint64(hashing.BASE) + words[i:i + n])
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    again = np.full(n, len(words) + 1, np.int64)
    again[order[:-1][same]] = order[1:][same] - order[:-1][same]
    again[row[:n] != row[gram - 1:]] = len(words) + 1
    begin = np.searchsorted(row, row, "left")
    close = np.searchsorted(row, row, "right")
    most = int((close - begin).max()) // exponent if len(words) else 0
    lows, highs, reach = [], [], 1
    while reach // 2 < most:
        need = _needed(reach // 2 + 1, reach, least, exponent) - gram + 1
        hit = np.concatenate([[False], again <= reach, [False]])
        # Neighbours in other rows end a stretch.
        edge = np.flatnonzero(hit[1:] != hit[:-1])
        low, high = edge[::2], edge[1::2]
        cut = row[low] != row[high - 1] if len(low) else none
        if len(low) and cut.any():
            at = np.flatnonzero(hit[1:-1])
            new = np.append(True, (np.diff(at) > 1) | (row[at[1:]] != row[at[:-1]]))
            low, high = at[new], at[np.append(np.flatnonzero(new)[1:], len(at)) - 1] + 1
        long = high - low >= need
        low, high = low[long], high[long]
        lows.append(np.maximum(low - 1, begin[low]))
        highs.append(np.minimum(high + reach + gram, close[low]))
        reach *= 2
    if not lows:
        return none, none
    low, high = np.concatenate(lows), np.concatenate(highs)
    order = np.argsort(low, kind="stable")
    low, high = low[order], high[order]
    far = np.maximum.accumulate(high) if len(high) else high
    new = np.ones(len(low), bool)
    # A stretch joins the one before if they meet in one row.
    new[1:] = (low[1:] > far[:-1]) | (row[low[1:]] != row[low[:-1]])
    first = np.flatnonzero(new)
    return low[first], far[np.append(first[1:], len(low)) - 1] if len(first) else none


class Words:
    """Words of a buffer of texts: where each lies, its row, and how many each row has."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        inside = ~hashing.is_space(data)
        border = np.zeros(len(data) + 1, bool)
        border[offsets] = True
        begin, stop = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1] | border[1:-1]
        stop[:-1] &= ~inside[1:] | border[1:-1]
        self.data, self.start, self.end = data, np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.count = np.bincount(self.row, minlength=len(offsets) - 1)
        self.first = np.cumsum(self.count) - self.count
        # Which word of the text stands at each place; an edit may repeat some.
        self.at = np.arange(len(self.start))

    def runs(self, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, runs as rows of start, length and period), by row, start and period."""
        hashes = hashing.slices(self.data, self.start, self.end)[self.at]
        raw, rows, found = self.data.tobytes(), [], []
        for low, high in zip(*(x.tolist() for x in stretches(hashes, self.row, least, exponent))):
            known: dict[bytes, int] = {}
            places = self.at[low:high]
            made = find_runs([known.setdefault(raw[a:b], len(known) + 1)
                              for a, b in zip(self.start[places].tolist(), self.end[places].tolist())], least, exponent)
            row = int(self.row[low])
            made[:, 0] += low - self.first[row]
            rows.append(np.full(len(made), row))
            found.append(made)
        if not found:
            return np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
        return np.concatenate(rows), np.concatenate(found)

    def collapsed(self, row: np.ndarray, runs: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Each row's words outside all but the first period of every run, a space behind each; where rows end."""
        change = np.zeros(len(self.at) + 1, np.int64)
        begin = self.first[row] + runs[:, 0]
        np.add.at(change, begin + runs[:, 2], 1)
        np.add.at(change, begin + runs[:, 1], -1)
        kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
        size = (self.end - self.start)[self.at[kept]] + 1
        ends = np.cumsum(size)
        from_ = np.repeat(self.start[self.at[kept]] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        out = np.append(self.data, np.uint8(32))[from_]
        out[ends - 1] = 32
        by = np.bincount(self.row[kept], weights=size, minlength=len(self.count)).astype(np.int64)
        return out.tobytes(), np.cumsum(by)


Edit = Callable[[Words, np.ndarray], None]


def _scan(docs: DataFrame, schema: dict[str, str], make: Callable[[Words, np.ndarray, np.ndarray], list[pa.Array]], least: int, exponent: int,
          edit: Edit | None = None) -> DataFrame:
    """``doc_id`` and what ``make`` gives for the words, rows and runs of a few texts at a time."""
    names = ["doc_id", *schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = hashing.buffers(batch.column(1))
            for first, stop, some, at in hashing.pieces(data, offsets):
                words, ids = Words(some, at), batch.column(0).slice(first, stop - first)
                if edit is not None:
                    edit(words, ids)
                yield pa.RecordBatch.from_arrays([ids, *make(words, *words.runs(least, exponent))], names=names)
        tidy()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{name} {kind}" for name, kind in schema.items()))


def periodic_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """One row per document: doc_id, its runs, and its text with every run cut down to its first period."""

    def make(words: Words, row: np.ndarray, runs: np.ndarray) -> list[pa.Array]:
        cuts = np.searchsorted(row, np.arange(len(words.count) + 1)).astype(np.int32)
        held = pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in range(3)], names=["start", "length", "period"])
        text, ends = words.collapsed(row, runs)
        begin = np.concatenate([[0], ends[:-1]]).tolist() if len(ends) else []
        return [pa.ListArray.from_arrays(pa.array(cuts), held),
                pa.array([text[a:max(a, b - 1)].decode() for a, b in zip(begin, ends.tolist())], pa.string())]

    return _scan(docs, {"runs": "array<struct<start:long,length:long,period:long>>", "collapsed": "string"}, make, least, exponent)


def repeat_tails(words: Words, ids: pa.Array) -> None:
    """Make a tenth of the texts periodic, chosen by the checksum of their id: from one word on, a few words repeat."""
    for row, (doc, n) in enumerate(zip(ids.to_pylist(), words.count.tolist())):
        if doc is None or not n:
            continue
        pick = zlib.crc32(str(doc).encode())
        if pick % 10:
            continue
        rest = pick // 10
        a = rest % n
        period = 1 + (n - a) // (3 + rest % 8)
        base = int(words.first[row]) + a
        words.at[base:base + n - a] = base + np.arange(n - a) % period


_DIGEST = {name: "long" for name in ("n_runs", "start", "length", "period", "exponent_milli")} | {
    "runs_sha256": "string", "collapsed_sha256": "string"}


def query(docs: DataFrame) -> DataFrame:
    """The longest run and digests of all runs and of the text without repeats, for every document."""

    def make(words: Words, row: np.ndarray, runs: np.ndarray) -> list[pa.Array]:
        n = len(words.count)
        cuts = np.searchsorted(row, np.arange(n + 1))
        order = np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1], row))
        some = np.flatnonzero(np.diff(cuts))
        best = np.zeros((n, 3), np.int64)
        best[some] = runs[order[cuts[some]]]
        lacks = np.diff(cuts) == 0
        listed = [",".join(map(str, r)) + "\n" for r in runs.tolist()]
        text, ends = words.collapsed(row, runs)
        begin = np.concatenate([[0], ends[:-1]]).tolist() if n else []
        return [pa.array(np.diff(cuts)), *(pa.array(best[:, i], mask=lacks) for i in range(3)),
                pa.array(1000 * best[:, 1] // np.maximum(best[:, 2], 1), mask=lacks),
                pa.array([hashlib.sha256("".join(listed[a:b]).encode()).hexdigest() for a, b in zip(cuts.tolist(), cuts[1:].tolist())], pa.string()),
                pa.array([hashlib.sha256(text[a:max(a, b - 1)]).hexdigest() for a, b in zip(begin, ends.tolist())], pa.string())]

    return _scan(docs, _DIGEST, make, LEAST, EXPONENT, repeat_tails)
