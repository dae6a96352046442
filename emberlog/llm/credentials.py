"""Secrets in texts: fixed rules, and formats inferred from what the rules find.

Rules. Three kinds of credentials are found by patterns (``assign``, ``access``, ``hex``).

Inference. What the rules match are labelled examples of a kind; all other tokens are examples of ordinary
text. The examples of a label form a prefix tree with counts, whose branches are classes of symbols. Level
by level, from the root, nodes whose endings, next symbols and next classes are as frequent within
Hoeffding's bound, and whose children are so too as far as there is evidence, are merged with all that
hangs below them. What is left is a probabilistic automaton
that knows a format's fixed letters, alphabets and lengths.

Scoring. Every token of at least LEAST_TOKEN symbols (no rule's value has less) that no rule's span touches is a
candidate, however long it is, and is scored to its end; a state without further ones follows itself, so what is
left of a token there counts at once, by how often it has each symbol. It is
reported under the kind whose automaton makes it ODDS times as likely as the one of ordinary text, if it is
also accepted by the automaton and as typical of the format as the examples are: the sum over its symbols of
surprise minus expected surprise stays within what all but TAIL of held-out examples show, and SLACK.

Texts may hold credentials that no rule finds, so ordinary examples typical of a format are left out before the
automaton of ordinary text is learned; unless they are a share of MIXED, as ordinary words then have that format.

Learning takes at most MAX_ROWS different examples of a label, those of the lowest hashes; every task passes
on its lowest ones only. They may be of any length: the tree is MAX_CHARS levels deep, and its deepest nodes count
all symbols that are left, so that alphabets hold to the end of a longer format and its lengths on average. The
bounds are parameters; rules and scoring see every text whole. Automata have at most a few thousand states and
go to all tasks.

Defined cases: a null or empty text has no spans; matches never cross texts; places are code points, ends
not included; kinds without examples get no further spans; rows of equal ids are scored each; no
rows give no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..workspace import Workspace
from . import hashing
from .encoder import tidy

KINDS = ("assign", "access", "hex")
ORDINARY = "ordinary"
MAX_ROWS, MAX_CHARS = 4_000, 128
ALPHA, ODDS, TAIL, SLACK, MIXED = 0.05, 1e6, 0.01, 3.0, 0.1
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX, LEAST_TOKEN = 8, 16, 32, 8
# Tokens tallied at once, and bytes beyond which one is tallied by itself.
BLOCK, LONG = 512, 4096
# Below so many strings two states always fit one another.
FEW = 8
# Weight of a symbol's class against the symbol, in strings; share of all that was never seen.
CLASS_WEIGHT, UNSEEN = 16.0, 1e-3

# Letters of A-Z come lower-cased to this pattern.
_ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_CLASSES = (b"0123456789", b"abcdef", b"ghijklmnopqrstuvwxyz", b"ABCDEF", b"GHIJKLMNOPQRSTUVWXYZ", b"+", b"/", b"_", b".", b"=", b"-")
_SYMBOLS = b"".join(_CLASSES)
_CLASS_SIZE = np.array([len(c) for c in _CLASSES])
_CLASS_OF = np.repeat(np.arange(len(_CLASSES)), _CLASS_SIZE)
_CLASS_AT = np.cumsum(_CLASS_SIZE) - _CLASS_SIZE
_GROUP = _CLASS_OF.tolist()
# Number of a byte among the symbols; none: -1.
_NUMBER = np.full(256, -1, np.int16)
_NUMBER[list(_SYMBOLS)] = np.arange(len(_SYMBOLS))
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
# Signs that end a sentence or part of one are no part of a token at its edges.
_EDGE = np.zeros(256, bool)
_EDGE[list(b".-/_+")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _stretches(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of a mask, as (from, to)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


class Scanned:
    """Rule matches and candidate tokens of a few texts, as places in ``data``, where a zero byte parts texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.offsets = offsets + np.arange(len(offsets))
        self.data = np.insert(data, offsets[1:], 0)
        raw = self.data.tobytes()
        found = [(0, m.start(), m.end(), m.start(2)) for m in _ASSIGN.finditer(_LOWER[self.data].tobytes())
                 if m.end() - m.start(2) >= LEAST_ASSIGN]
        found += [(1, m.start(), m.end(), m.start()) for m in _ACCESS.finditer(raw) if m.end() - m.start() >= LEAST_ACCESS]
        low, high = _stretches(_HEX[self.data])
        long = np.flatnonzero(high - low >= LEAST_HEX)
        found += [(2, a, b, a) for a, b in zip(low[long].tolist(), high[long].tolist())]
        spans = np.array(found, np.int64).reshape(-1, 4)
        self.kind, self.start, self.end, self.value = spans[np.lexsort((spans[:, 0], spans[:, 1]))].T
        low, high = _stretches(_NUMBER[self.data] >= 0)
        touched = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(touched, self.start, 1)
        np.add.at(touched, self.end, -1)
        touched = np.concatenate([[0], np.cumsum(np.cumsum(touched[:-1]) > 0)])
        free = (high - low >= LEAST_TOKEN) & (touched[high] == touched[low])
        self.low, self.high = self.trimmed(low[free], high[free])

    def trimmed(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens without the signs at their edges, those that are long enough then."""
        plain = np.flatnonzero(~_EDGE[self.data])
        first = plain[np.minimum(np.searchsorted(plain, low), len(plain) - 1)] if len(plain) else high
        last = plain[np.searchsorted(plain, high) - 1] + 1 if len(plain) else low
        long = np.flatnonzero(last - first >= LEAST_TOKEN)
        return first[long], last[long]

    def rows(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, place, "right") - 1

    def points(self, *places: np.ndarray) -> list[np.ndarray]:
        """Places as code points of their own text."""
        before = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        base = before[self.offsets[self.rows(places[0])]]
        return [before[p] - base for p in places]


@dataclass
class Automaton:
    """A probabilistic automaton: next state and log chance per state and symbol, of ending, expected surprise.

    ``never`` (and ``never_ends``) mark what no example does in a state that many reach: no string of the format does.
    """

    next: np.ndarray
    chance: np.ndarray
    ends: np.ndarray
    expected: np.ndarray
    never: np.ndarray
    never_ends: np.ndarray
    depth: int
    limit: float = math.inf

    def score(self, data: np.ndarray, low: np.ndarray, high: np.ndarray, tails: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood of each token, and how much more surprising it is than expected (without bound if not accepted).

        ``tails`` tells how often each symbol follows the token's end, if only its first MAX_CHARS are given.
        """
        state, total, excess = np.zeros(len(low), np.int64), np.zeros(len(low)), np.zeros(len(low))
        last = (self.next == np.arange(len(self.next))[:, None]).all(1)
        live, step = np.arange(len(low)), 0
        while len(live):
            stays = last[state[live]]
            for some in _blocks(live[stays]):
                at, left = state[some], _tallied(data, low[some] + step, high[some])
                if tails is not None:
                    left += tails[some]
                chance = (left * self.chance[at]).sum(1) + self.ends[at]
                total[some] += chance
                excess[some] -= chance + (left.sum(1) + 1) * self.expected[at]
                excess[some[((left > 0) & self.never[at]).any(1) | self.never_ends[at]]] = np.inf
            live = live[~stays]
            over = low[live] + step >= high[live]
            done = live[over]
            total[done] += self.ends[state[done]]
            excess[done] -= self.ends[state[done]] + self.expected[state[done]]
            excess[done[self.never_ends[state[done]]]] = np.inf
            live = live[~over]
            at, symbol = state[live], _NUMBER[data[low[live] + step]]
            chance = self.chance[at, symbol]
            total[live] += chance
            excess[live] -= chance + self.expected[at]
            excess[live[self.never[at, symbol]]] = np.inf
            state[live] = self.next[at, symbol]
            step += 1
        return total, excess


def _blocks(some: np.ndarray) -> Iterator[np.ndarray]:
    return (some[i:i + BLOCK] for i in range(0, len(some), BLOCK))


def _tallied(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How often each symbol is in each of some tokens."""
    size, symbols = high - low, len(_SYMBOLS)
    short = np.where(size > LONG, 0, size)
    at = np.arange(short.sum()) + np.repeat(low - np.cumsum(short) + short, short)
    row = np.repeat(np.arange(len(low)), short)
    out = np.bincount(row * symbols + _NUMBER[data[at]], minlength=len(low) * symbols).reshape(-1, symbols)
    for i in np.flatnonzero(size > LONG):
        out[i] = np.bincount(_NUMBER[data[low[i]:high[i]]], minlength=symbols)
    return out


def _bound(n: int, m: int) -> float:
    """How far two frequencies of one chance may lie apart (Hoeffding)."""
    return math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))


class _Tree:
    """Prefix tree over classes of symbols whose nodes are merged, level by level.

    A node knows how many strings reach it, end there, and go on with each symbol; which node is next
    depends on the class of the symbol, so alphabets need few examples and fixed letters are still seen.
    What follows a string (``tails``: how often each symbol) counts where the string leads, and it ends there.
    """

    def __init__(self, examples: list[bytes], tails: np.ndarray):
        self.kids: list[dict[int, int]] = [{}]
        steps = []
        ends = [0]
        deepest = []
        for text in examples:
            node = 0
            for symbol in _NUMBER[list(text)].tolist():
                steps.append(node * len(_SYMBOLS) + symbol)
                group = _GROUP[symbol]
                child = self.kids[node].get(group)
                if child is None:
                    child = self.kids[node][group] = len(self.kids)
                    self.kids.append({})
                    ends.append(0)
                node = child
            ends[node] += 1
            deepest.append(node)
        self.ends = np.array(ends)
        self.symbols = np.bincount(steps, minlength=len(ends) * len(_SYMBOLS)).reshape(len(ends), -1)
        self.count = self.ends + self.symbols.sum(1)
        np.add.at(self.symbols, deepest, tails)

    def fits(self, a: int, b: int) -> bool:
        """Whether two states may be one: endings, symbols and classes alike, and so on for what follows."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if min(self.count[a], self.count[b]) < FEW:
                continue
            n, m = int(self.ends[a] + self.symbols[a].sum()), int(self.ends[b] + self.symbols[b].sum())
            bound = _bound(n, m)
            apart = self.symbols[a] / n - self.symbols[b] / m
            if (abs(self.ends[a] / n - self.ends[b] / m) > bound or np.abs(apart).max() > bound
                    or np.abs(np.add.reduceat(apart, _CLASS_AT)).max() > bound):
                return False
            todo += [(self.kids[a][g], self.kids[b][g]) for g in self.kids[a].keys() & self.kids[b].keys()]
        return True

    def fold(self, a: int, b: int) -> None:
        """Merge b and all below it into a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.count[a] += self.count[b]
            self.ends[a] += self.ends[b]
            self.symbols[a] += self.symbols[b]
            for group, child in self.kids[b].items():
                own = self.kids[a].get(group)
                if own is None:
                    self.kids[a][group] = child
                else:
                    todo.append((own, child))
            self.kids[b] = {}

    def merge(self) -> list[list[int]]:
        """Merge compatible states, those of most examples first; the states of each level.

        A state joins one that follows the same state before it, else any that fits if there is evidence.
        """
        levels = [[0]]
        while levels[-1]:
            held: list[int] = []
            kept: dict[int, int] = {}
            before = {child: {node} for node in levels[-1] for child in self.kids[node].values()}
            for child in sorted(before, key=lambda c: (-int(self.count[c]), c)):
                near = [s for s in held if before[s] & before[child]]
                far = [s for s in held if not before[s] & before[child]] if self.count[child] >= FEW else []
                kept[child] = next((s for s in near + far if self.fits(s, child)), child)
                if kept[child] == child:
                    held.append(child)
                else:
                    self.fold(kept[child], child)
                    before[kept[child]] |= before[child]
            for node in levels[-1]:
                self.kids[node] = {group: kept[child] for group, child in self.kids[node].items()}
            levels.append(held)
        return levels[:-1]


def infer(examples: list[bytes], tails: np.ndarray | None = None) -> Automaton:
    """The automaton of some strings, and how surprising a string of its format may be: as all but TAIL of
    every fifth example are to an automaton of the others, and SLACK more."""
    if tails is None:
        tails = np.zeros((len(examples), len(_SYMBOLS)), np.int64)
    made, fifth, others = _inferred(examples, tails), examples[::5], np.arange(len(examples)) % 5 > 0
    rest = [e for e, other in zip(examples, others) if other]
    excess = (_inferred(rest, tails[others]) if rest else made).score(*_laid(fifth), tails[::5])[1]
    excess = np.sort(excess[np.isfinite(excess)])
    made.limit = (float(excess[min(len(excess) - 1, int(len(excess) * (1 - TAIL)))]) if len(excess) else 0.0) + SLACK
    return made


def _inferred(examples: list[bytes], tails: np.ndarray) -> Automaton:
    """A symbol not seen in a state shares the chance of its class there; a class not seen goes where most go."""
    tree = _Tree(examples, tails)
    levels = tree.merge()
    states = [s for level in levels for s in level]
    number = {s: i for i, s in enumerate(states)}
    n, size = len(states), len(_SYMBOLS)
    counts, ends = tree.symbols[states].astype(float), tree.ends[states].astype(float)
    total = np.maximum(counts.sum(1) + ends, 1)
    by_class = np.add.reduceat(counts, _CLASS_AT, 1)
    shared = (by_class / _CLASS_SIZE)[:, _CLASS_OF]
    weight = (CLASS_WEIGHT / (by_class + CLASS_WEIGHT))[:, _CLASS_OF]
    chance = (1 - UNSEEN) * ((1 - weight) * counts + weight * shared) / total[:, None] + UNSEEN / (size + 1)
    end = (1 - UNSEEN) * ends / total + UNSEEN / (size + 1)
    following = np.empty((n, len(_CLASSES)), np.int64)
    for i, s in enumerate(states):
        usual = max(tree.kids[s], key=lambda g: by_class[i, g], default=None)
        following[i] = i if usual is None else number[tree.kids[s][usual]]
        for group, child in tree.kids[s].items():
            following[i, group] = number[child]
    expected = -(chance * np.log(chance)).sum(1) - end * np.log(end)
    many = tree.count[states] >= FEW
    never = ((by_class == 0) & many[:, None])[:, _CLASS_OF]
    return Automaton(following[:, _CLASS_OF], np.log(chance), np.log(end), expected, never, (ends == 0) & many, len(levels))


def _buffers_scanned(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, int, int, Scanned]]:
    for batch in batches:
        data, offsets = hashing.buffers(batch.column(text))
        for first, stop, some, at in hashing.pieces(data, offsets):
            yield batch, first, stop, Scanned(some, at)


def examples(docs: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> DataFrame:
    """Examples of each label that may be among its ``max_rows`` lowest hashes: label, hash, value.

    Of a longer one ``value`` has the first ``max_chars`` symbols, and ``tail`` how often each symbol follows them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, tuple[bytes, bytes]]] = {label: {} for label in (*KINDS, ORDINARY)}
        most = {label: (1 << 64) for label in held}
        for _, _, _, found in _buffers_scanned(batches, 0):
            for k, label in enumerate(KINDS):
                of = found.kind == k
                _lowest(held, most, label, found.data, *found.trimmed(found.value[of], found.end[of]), max_rows, max_chars)
            _lowest(held, most, ORDINARY, found.data, found.low, found.high, max_rows, max_chars)
        rows = [(label, key, *value) for label, by in held.items() for key, value in by.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array(np.array([r[1] for r in rows], np.uint64).view(np.int64)),
             pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())],
            names=["label", "hash", "value", "tail"])
        tidy()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(
        run, "label string, hash long, value binary, tail binary").distinct()


def _lowest(held, most, label, data, low, high, max_rows, max_chars) -> None:
    """Keep the different strings of the lowest hashes, ``max_rows`` of them."""
    keys = hashing.slices(data, low, high)
    some = np.flatnonzero(keys < most[label]) if most[label] < 1 << 64 else np.arange(len(keys))
    by = held[label]
    for key, a, b in zip(keys[some].tolist(), low[some].tolist(), high[some].tolist()):
        if key not in by:
            cut = min(b, a + max_chars)
            by[key] = data[a:cut].tobytes(), np.bincount(_NUMBER[data[cut:b]], minlength=len(_SYMBOLS)).tobytes() if cut < b else b""
    if len(by) > 2 * max_rows:
        held[label] = dict(sorted(by.items())[:max_rows])
        most[label] = max(held[label])


def _tails(rows: list[bytes]) -> np.ndarray:
    """Numbers of symbols that follow each example; nothing: none do."""
    return np.frombuffer(b"".join(r or bytes(8 * len(_SYMBOLS)) for r in rows), np.int64).reshape(-1, len(_SYMBOLS))


def _laid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings behind one another, and where each begins and ends."""
    size = np.array([len(t) for t in texts], np.int64)
    high = np.cumsum(size)
    return np.frombuffer(b"".join(texts), np.uint8), high - size, high


def unlike(texts: list[bytes], tails: np.ndarray, models: dict[str, Automaton], mixed: float = MIXED) -> np.ndarray:
    """Which ordinary examples are not typical of a format, or of one that so many have that ordinary words have it too."""
    keep = np.ones(len(texts), bool)
    for model in models.values():
        typical = model.score(*_laid(texts), tails)[1] <= model.limit
        if typical.sum() < mixed * len(texts):
            keep &= ~typical
    return keep


def learn(docs: DataFrame, ws: Workspace, max_rows: int = MAX_ROWS) -> dict[str, Automaton]:
    """An automaton for each label that has examples. One task learns one label from at most ``max_rows`` strings."""
    staged = ws.stage(examples(docs, max_rows), "examples")
    order = (F.col("hash").bitwiseXOR(F.lit(-1 << 63)), "value", "tail")
    lowest = {label: staged.filter(F.col("label") == label).orderBy(*order).limit(max_rows) for label in (*KINDS, ORDINARY)}

    def fitted(rows: DataFrame, known: dict[str, Automaton]) -> dict[str, Automaton]:
        def fit(table: pa.Table) -> pa.Table:
            texts, tails = zip(*sorted(zip(table.column("value").to_pylist(), table.column("tail").to_pylist())))
            tails = _tails(tails)
            keep = unlike(texts, tails, known)
            some = np.flatnonzero(keep if keep.any() else ~keep)
            made = infer([texts[i] for i in some], tails[some])
            return pa.table({"label": [table.column("label")[0].as_py()], "model": pa.array([pickle.dumps(made)], pa.binary())})

        return {r.label: pickle.loads(r.model) for r in rows.groupBy("label").applyInArrow(fit, "label string, model binary").collect()}

    kinds = None
    for label in KINDS:
        kinds = lowest[label] if kinds is None else kinds.unionByName(lowest[label])
    models = fitted(kinds, {})
    return models | fitted(lowest[ORDINARY], models)


def matches(found: Scanned, models: dict[str, Automaton]) -> tuple[np.ndarray, ...]:
    """(kind, from, to) of the candidates that the automata report, by place."""
    low, high = found.low, found.high
    best, kind = np.zeros(len(low)), np.full(len(low), -1)
    for k, name in enumerate(KINDS):
        if (model := models.get(name)) is None:
            continue
        likely, excess = model.score(found.data, low, high)
        some = np.flatnonzero(excess <= model.limit)
        likely = likely[some]
        if ORDINARY in models:
            usual = models[ORDINARY].score(found.data, low[some], high[some])[0]
        else:
            usual = -(high[some] - low[some] + 1) * math.log(len(_SYMBOLS) + 1)
        gain = likely - usual
        better = (gain >= math.log(ODDS)) & ((kind[some] < 0) | (gain > best[some]))
        best[some[better]], kind[some[better]] = gain[better], k
    at = np.flatnonzero(kind >= 0)
    return kind[at], low[at], high[at]


def find(docs: DataFrame, models: dict[str, Automaton]) -> DataFrame:
    """One row per document: doc_id and all spans in order: kind, start, end, whether a rule found it."""
    held = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(KINDS)
        for batch, first, stop, found in _buffers_scanned(batches, 1):
            more = matches(found, held.value)
            kind, start, end = (np.concatenate(x) for x in zip((found.kind, found.start, found.end), more))
            rule = np.arange(len(kind)) < len(found.kind)
            order = np.lexsort((kind, start))
            kind, start, end, rule = kind[order], start[order], end[order], rule[order]
            cuts = np.searchsorted(start, found.offsets).astype(np.int32)
            a, b = found.points(start, end)
            spans = pa.StructArray.from_arrays([pa.array(names[kind].tolist(), pa.string()), pa.array(a), pa.array(b), pa.array(rule)],
                                               names=["kind", "start", "end", "rule"])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, stop - first), pa.ListArray.from_arrays(pa.array(cuts), spans)],
                                             names=["doc_id", "spans"])
        tidy()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,rule:boolean>>")


def query(docs: DataFrame, ws: Workspace) -> DataFrame:
    """Numbers of rule matches, their digest, and all spans, for every document."""
    found = find(docs, learn(docs, ws))
    rules = F.filter("spans", lambda s: s["rule"])
    many = lambda kind: F.size(F.filter("spans", lambda s: s["rule"] & (s["kind"] == kind))).cast("long")
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *[many(kind).alias(f"n_{kind}") for kind in KINDS],
                        F.sha2(written(rules).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
