"""Near-duplicate join: word 5-gram Jaccard of 0.8 or more, candidates pruned by Bayes, rest exact.

1. Texts with equal sets of 5-grams are one class; all that follows is about classes.
2. Every class has HASHES MinHash values in BANDS bands. Two classes of likeness 0.8 share no band
   with a probability of 1e-7. Classes that share a band are compared value by value, STEP at a time:
   a pair is dropped as soon as the posterior probability (uniform prior, so a beta posterior) of
   reaching the threshold falls below TOLERANCE. Pairs that stay join their classes to candidate
   groups; only a spanning forest of each bucket leaves the task, never all pairs.
3. Within a candidate group all pairs are verified exactly from the texts, in blocks of at most BLOCK
   classes on either side. What comes out is the number of links of each class and a spanning forest
   of the true links, from which class ids follow.

A bucket of more than BLOCK classes is first compared with its smallest class: those near it are tied to
it (two classes within 0.2 of each other and one of them within 0.2 of a third lie within 0.4 of
it, so the looser likeness of 0.6 is asked for). The rest is compared in pairs of blocks. So no task
holds more than two blocks, whatever one bucket holds, and no pair is skipped.

Defined cases: words are runs without white space; a text of fewer than five words has one gram of
all its words; texts without words are copies of one another; a null text is the empty text; each
row is a document and counts as a link, also rows that repeat; a null id is never the name of a
class while another id is there; no rows give no rows. Of each group the stage keeps one row, the
least by id and text, and of rows that repeat any one; documents without an id, and documents of one
id with unrelated texts, are documents of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.lookup import fits_broadcast, lookup_join
from ..workspace import Workspace
from . import hashing

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 40, 5
HASHES, STEP, TOLERANCE = BANDS * ROWS, 20, 1e-7
BLOCK = 512
NO_ID = (1 << 63) - 1
_NODE = "struct<id:bigint,set:bigint>"


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sets of word 5-grams of UTF-8 rows, as hashes: all rows' sorted sets, and where each begins."""
    rows = len(offsets) - 1
    inside = ~hashing.is_space(data)
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | border[1:-1]
    stop[:-1] &= ~inside[1:] | border[1:-1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    word = hashing.slices(data, start, end)
    row = np.searchsorted(offsets, start, "right") - 1
    count = np.bincount(row, minlength=rows)
    first = np.cumsum(count) - count
    at = np.arange(len(word)) - first[row]
    grams = np.zeros(len(word), np.uint64)
    # A gram is a polynomial in its words' hashes; a short text's only gram holds all its words.
    whole = at + WORDS <= count[row]
    whole |= (at == 0) & (count[row] < WORDS)
    for i in range(WORDS):
        there = np.flatnonzero(whole & (at + i < count[row]))
        grams[there] = grams[there] * np.uint64(hashing.BASE) + word[there + i]
    keep = np.flatnonzero(whole)
    row, grams = row[keep], hashing.mixed(grams[keep])
    order = np.lexsort((grams, row))
    row, grams = row[order], grams[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])
    row, grams = row[new], grams[new]
    return grams, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int64)


def set_hashes(grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One hash per set: the sum of its members' hashes, mixed."""
    total = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(grams, out=total[1:])
    return hashing.mixed(total[starts[1:]] - total[starts[:-1]] + np.diff(starts).astype(np.uint64)).view(np.int64)


def _functions() -> tuple[np.ndarray, np.ndarray]:
    """HASHES multipliers (odd) and shifts, from a rule."""
    made = hashing.mixed(np.arange(2 * HASHES, dtype=np.uint64) + np.uint64(7))
    return (made[:HASHES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (made[HASHES:] >> np.uint64(32)).astype(np.uint32)


def signatures(grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHash values of non-empty sets, 16 bits each: one row per set."""
    low = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts) - 1, HASHES), np.uint16)
    for i, (a, b) in enumerate(zip(*_functions())):
        least = np.minimum.reduceat(low * a + b, starts[:-1])
        out[:, i] = (least ^ (least >> np.uint32(16))) & np.uint32(0xFFFF)
    return out


def _keys() -> tuple[Column, Column]:
    """``_id`` and ``body``: the id of a document (NO_ID for null) and the hash of its text."""
    return (F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"),
            F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("body"))


def described(docs: DataFrame) -> DataFrame:
    """One row per document: id, its keys, 128-bit hash of its set, MinHash values (null for the empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = hashing.buffers(batch.column(3))
            for first, end, part, at in hashing.pieces(data, offsets):
                grams, starts = shingles(part, at)
                size = np.diff(starts)
                one, two = set_hashes(grams, starts), set_hashes(hashing.mixed(grams ^ np.uint64(hashing.OTHER)), starts)
                filled = np.flatnonzero(size)
                held = signatures(grams, np.append(starts[filled], len(grams))) if len(filled) else np.zeros((0, HASHES), np.uint16)
                made: list[bytes | None] = [None] * (end - first)
                for i, row in zip(filled.tolist(), held):
                    made[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(first, end - first) for i in range(3)), pa.array(one), pa.array(two),
                     pa.array(made, pa.binary())], names=["doc_id", "_id", "body", "set", "set2", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_keys(), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, _id long, body long, set long, set2 long, sig binary")


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, fewest matches to go on): with fewer, the likeness reaches the threshold
    with a probability below the tolerance. For m of n matches and a uniform prior that probability is
    the chance of at most m successes in n + 1 trials."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, least = 0.0, 0
        for m in range(n + 2):
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                least = m
                break
        out.append((n, least))
    return out


def _survivors(sig: np.ndarray, a: np.ndarray, b: np.ndarray, rule: list[tuple[int, int]]) -> np.ndarray:
    """Places of the pairs (a, b) that no step drops."""
    alive, matches, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, least in rule:
        if not len(alive):
            break
        matches = matches + (sig[a[alive], done:n] == sig[b[alive], done:n]).sum(1)
        keep = matches >= least
        alive, matches, done = alive[keep], matches[keep], n
    return alive


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each component of the pairs (a, b) over 0..n-1."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _sig(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), HASHES)


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, id, set, side, sig) sorted by key to a spanning forest of the pairs that stay.

    ``side``: 0 for a bucket compared within itself, 1 and 2 for two blocks compared across.
    """
    rule = least_matches(THRESHOLD)
    for table in hashing.whole_keys(batches):
        key, id_, set_, side = (np.asarray(table.column(i)) for i in range(4))
        sig = _sig(table.column(4))
        left, right = [], []
        for step in range(1, len(key)):
            a = np.flatnonzero((key[step:] == key[:-step]))
            if not len(a):
                break
            a = a[(side[a] == 0) | (side[a] != side[a + step])]
            a = a[_survivors(sig, a, a + step, rule)]
            left.append(a)
            right.append(a + step)
        if not left:
            continue
        a, b = np.concatenate(left), np.concatenate(right)
        # A class may be there under several keys; its places are one node each, so no key matters here.
        root = _roots(len(key), a, b)
        at = np.flatnonzero(root != np.arange(len(key)))
        yield _edges(id_[root[at]], set_[root[at]], id_[at], set_[at])


_EDGE = f"a {_NODE}, b {_NODE}"


def _edges(id_a, set_a, id_b, set_b) -> pa.RecordBatch:
    node = lambda i, s: pa.StructArray.from_arrays([pa.array(i), pa.array(s)], names=["id", "set"])
    return pa.RecordBatch.from_arrays([node(id_a, set_a), node(id_b, set_b)], names=["a", "b"])


def _blocks(rows: DataFrame, key: str, size: str, node: str) -> DataFrame:
    """Deal the members of a group to pairs of blocks: adds ``task`` and ``side``.

    A group of at most BLOCK members is one block. The pair (i, i) is a block compared within
    itself (side 0), (i, j) are two compared across (sides 1 and 2).
    """
    blocks = F.ceil(F.col(size) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64(F.col(node)), F.col("_blocks")).cast("int")
    spread = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda j: F.struct(
        F.xxhash64(F.col(key), F.least(j, F.col("_own")), F.greatest(j, F.col("_own"))).alias("task"),
        F.when(j == F.col("_own"), 0).when(F.col("_own") < j, 1).otherwise(2).alias("side")))
    return (rows.withColumn("_blocks", blocks).withColumn("_own", own)
            .select("*", F.inline(spread)).drop("_blocks", "_own"))


def candidate_edges(classes: DataFrame, ws: Workspace) -> DataFrame:
    """Spanning forest of the classes that may be near: a, b (nodes)."""

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = _sig(batch.column(1)).astype(np.uint64)
            keys = np.zeros((len(sig), BANDS), np.uint64)
            for i in range(ROWS):
                keys = keys * np.uint64(hashing.BASE) + sig[:, i::ROWS]
            keys = hashing.mixed(keys + np.arange(BANDS, dtype=np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64).ravel()), batch.column(0).take(pa.array(np.repeat(np.arange(len(sig)), BANDS)))],
                names=["key", "node"])

    filled = classes.filter(F.col("sig").isNotNull())
    bands = filled.select("node", "sig").mapInArrow(banded, f"key long, node {_NODE}")
    buckets = ws.stage(bands.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("hub"))
                       .filter(F.col("size") > 1), "buckets", measure=True)
    members = ws.stage(lookup_join(bands, buckets, ["key"], weight="size"), "members", measure=True)
    # No class is in more than BANDS buckets.
    signed = ws.stage(members.join(filled.select("node", "sig"), "node"), "signed")
    columns = [F.col("node.id").alias("id"), F.col("node.set").alias("set")]
    little = signed.filter(F.col("size") <= BLOCK).select("key", *columns, F.lit(0).alias("side"), "sig")

    def near_hub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = least_matches(2 * THRESHOLD - 1)
        for batch in batches:
            both = np.concatenate([_sig(batch.column("sig")), _sig(batch.column("hub_sig"))])
            n = batch.num_rows
            near = np.zeros(n, bool)
            near[_survivors(both, np.arange(n), np.arange(n) + n, rule)] = True
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "node", "hub", "sig")), pa.array(near)],
                                             names=["key", "node", "hub", "sig", "near"])

    big = signed.filter(F.col("size") > BLOCK)
    hubs = big.filter(F.col("node") == F.col("hub")).select("key", F.col("sig").alias("hub_sig"))
    # Few buckets are this large: one row each.
    tied = ws.stage(big.join(_small(hubs, ws), "key").select("key", "node", "hub", "sig", "hub_sig").mapInArrow(
        near_hub, f"key long, node {_NODE}, hub {_NODE}, sig binary, near boolean"), "tied")
    stars = tied.filter(F.col("near") & (F.col("node") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("node").alias("b"))
    # Those far from the smallest class are compared with all of their bucket, in pairs of blocks.
    far = tied.filter(~F.col("near")).groupBy("key").agg(F.count(F.lit(1)).alias("far"))
    rest = (tied.join(_small(far, ws), "key").join(_small(tied.groupBy("key").agg(F.count(F.lit(1)).alias("size")), ws), "key"))
    dealt = _blocks(rest, "key", "size", "node").select(F.col("task").alias("key"), *columns, "side", "sig")
    compared = (little.unionByName(dealt).repartition("key").sortWithinPartitions("key", "id", "set")
                .mapInArrow(_bucket_edges, _EDGE))
    return ws.stage(compared.unionByName(stars).distinct(), "edges", measure=True)


def _small(df: DataFrame, ws: Workspace) -> DataFrame:
    held = ws.stage(df, "lookup", measure=True)
    return F.broadcast(held) if fits_broadcast(held) else held


def components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(node, root) of every node of an edge list; the root is the smallest node of its component.

    Each round, every node takes the least root among its own and its neighbours', then the root of
    that root. Rounds are written to the shared folder, so a lost executor costs one round.
    """
    both = ws.stage(edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
                    .unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct(), "both", measure=True)
    roots = ws.stage(both.groupBy("node").agg(F.min("other").alias("other"))
                     .select("node", F.least("node", "other").alias("root")), "roots", measure=True)
    while True:
        far = both.join(roots.select(F.col("node").alias("other"), "root"), "other").groupBy("node").agg(F.min("root").alias("near"))
        least = ws.stage(roots.join(far, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root")), "least", measure=True)
        up = least.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = ws.stage(least.join(up, "root", "left").select("node", "old", F.coalesce("above", "root").alias("root")), "roots", measure=True)
        if new.filter(F.col("old") != F.col("root")).isEmpty():
            return new.select("node", "root")
        roots = new.select("node", "root")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (task, id, set, copies, side, text) sorted by task to links and a spanning forest.

    All pairs of a task are counted exactly: sets as 0/1 rows, whose products are the sizes of
    intersections, a few thousand grams at a time.
    """
    for table in hashing.whole_keys(batches):
        task, id_, set_, copies, side = (np.asarray(table.column(i)) for i in range(5))
        texts = table.column(5).combine_chunks()
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
        cuts = np.flatnonzero(np.append(True, task[1:] != task[:-1]))
        for low, high in zip(cuts.tolist(), np.append(cuts[1:], len(task)).tolist()):
            # Rows that repeat in the table are one class here.
            _, one = np.unique(np.stack([id_[low:high], set_[low:high]]), axis=1, return_index=True)
            one = np.sort(one) + low
            n = len(one)
            grams, starts = shingles(*hashing.buffers(texts.take(pa.array(one))))
            size = np.diff(starts)
            _, column = np.unique(grams, return_inverse=True)
            owner = np.repeat(np.arange(n), size)
            order = np.argsort(column, kind="stable")
            column, owner = column[order], owner[order]
            shared = np.zeros((n, n))
            for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
                a, b = np.searchsorted(column, [first, first + 4096])
                part = np.zeros((n, min(4096, int(column[b - 1]) - first + 1)), np.float32)
                part[owner[a:b], column[a:b] - first] = 1
                shared += part @ part.T
            union = size[:, None] + size[None, :] - shared
            near = shared >= THRESHOLD * union - 1e-9
            near &= (side[one][:, None] == 0) | (side[one][:, None] != side[one][None, :])
            np.fill_diagonal(near, False)
            a, b = np.nonzero(np.triu(near))
            root = one[_roots(n, a, b)]
            links = near @ copies[one]
            node = lambda i: pa.StructArray.from_arrays([pa.array(id_[i]), pa.array(set_[i])], names=["id", "set"])
            yield pa.RecordBatch.from_arrays([node(one), node(root), pa.array(links.astype(np.int64))], names=["node", "root", "links"])


def near_duplicates(docs: DataFrame, ws: Workspace) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, n_copies, and its keys and ``root``.

    ``class_id``: the least id of the documents that links connect. ``n_links``: other documents of a
    likeness of THRESHOLD or more, copies included. ``n_copies``: documents of the same set. ``root``:
    the node that names the group, which ``class_id`` alone does not (ids may be null or repeat).
    """
    rows = ws.stage(described(docs), "described")
    classes = ws.stage(rows.groupBy("set", "set2").agg(
        F.min(F.struct("_id", "body")).alias("least"), F.count(F.lit(1)).alias("copies"), F.first("sig", True).alias("sig"))
        .select(F.struct(F.col("least._id").alias("id"), "set").alias("node"), F.col("least.body").alias("body"),
                "set", "set2", "copies", "sig"), "classes", measure=True)
    edges = candidate_edges(classes, ws)
    groups = components(edges, ws)
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    # A group's nodes join its size by the root; the count folds in each task first.
    asked = ws.stage(lookup_join(groups, ws.stage(sizes, "sizes", measure=True), ["root"], weight="size")
                     .join(classes.select("node", "body", "copies"), "node")
                     .select(F.col("node.id").alias("_id"), "body", "node", "root", "size", "copies"),
                     "asked", measure=True)
    source = docs.select(*_keys(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = lookup_join(source, asked, ["_id", "body"], weight="copies")
    dealt = (_blocks(_once(found), "root", "size", "node")
             .select("task", F.col("node.id").alias("id"), F.col("node.set").alias("set"), "copies", "side", "text")
             .repartition("task").sortWithinPartitions("task", "id", "set"))
    verified = ws.stage(dealt.mapInArrow(_verify, f"node {_NODE}, root {_NODE}, links long"), "verified")
    links = verified.groupBy("node").agg(F.sum("links").alias("links"), F.count(F.lit(1)).alias("tasks"), F.min("root").alias("root"))
    links = ws.stage(links, "links", measure=True)
    if not links.filter(F.col("tasks") > 1).isEmpty():
        # Groups of several blocks: their forests meet here.
        tied = verified.filter(F.col("node") != F.col("root")).select(F.col("root").alias("a"), F.col("node").alias("b"))
        joined = components(ws.stage(tied.distinct(), "tied"), ws)
        links = links.drop("root").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = (classes.join(links.select("node", "links", "root"), "node", "left")
             .select("set", "set2", "copies", F.coalesce("root", "node").alias("root"),
                     F.coalesce("links", F.lit(0).cast("long")).alias("links")))
    named = ws.stage(named, "named", measure=True)
    out = lookup_join(rows.select("doc_id", "_id", "body", "set", "set2"), named, ["set", "set2"], weight="copies")
    class_id = F.when(F.col("root.id") != NO_ID, F.col("root.id"))
    return out.select("doc_id", class_id.alias("class_id"), (F.col("links") + F.col("copies") - 1).alias("n_links"),
                      F.col("copies").alias("n_copies"), "_id", "body", "root")


def _once(found: DataFrame) -> DataFrame:
    """Of rows that repeat an id and a text one of each batch, so that they need not meet in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.stack([np.asarray(batch.column("_id")), np.asarray(batch.column("body"))])
            _, one = np.unique(keys, axis=1, return_index=True)
            yield batch.take(pa.array(np.sort(one))) if len(one) < batch.num_rows else batch

    return found.mapInArrow(run, found.schema)


def query(docs: DataFrame, ws: Workspace) -> DataFrame:
    return near_duplicates(docs, ws).select("doc_id", "class_id", "n_links", "n_copies")


def stage(docs: DataFrame, ws: Workspace) -> DataFrame:
    """``docs`` with one row of each group: the least by id and text, of rows that repeat any one."""
    # Texts that may stand for their group: those of its least id. No two groups share an id and a text.
    least = ws.stage(near_duplicates(docs, ws).filter(F.col("_id") == F.col("root.id")).groupBy("root", "_id", "body")
                     .agg(F.count(F.lit(1)).alias("rows")), "least", measure=True)
    several = ws.stage(least.groupBy("root").agg(F.sum("rows").alias("n"), F.count(F.lit(1)).alias("texts"))
                       .filter(F.col("n") > 1), "several", measure=True)
    asked = ws.stage(lookup_join(least, several, ["root"], "left", weight="texts")
                     .select("_id", "body", "rows", F.when(F.col("n").isNotNull(), F.col("root")).alias("group")),
                     "asked", measure=True)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = lookup_join(docs.select(*_keys(), whole), asked, ["_id", "body"], weight="rows")
    left = found.filter(F.col("group").isNull()).select("row")
    if not several.isEmpty():
        text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
        left = left.unionByName(found.filter(F.col("group").isNotNull()).groupBy("group")
                                .agg(F.min_by("row", text).alias("row")).select("row"))
    return left.select("row.*")


SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [list_aggregate(w, 'string_agg', ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: list_aggregate(w[i:i + {WORDS - 1}], 'string_agg', ' '))) END AS g FROM d),
c AS (SELECT list_sort(g) AS g, min(doc_id) AS id, count(*) AS copies FROM s GROUP BY list_sort(g)),
e AS (SELECT id, copies, len(g) AS n, unnest(g) AS x FROM c),
p AS (SELECT a.id AS a, b.id AS b, any_value(b.copies) AS copies FROM e a JOIN e b ON a.x = b.x AND a.id <> b.id
  GROUP BY a.id, b.id, a.n, b.n HAVING count(*) >= {THRESHOLD} * (a.n + b.n - count(*)) - 1e-9),
r AS (SELECT id, id AS root FROM c UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.id),
k AS (SELECT id, min(root) AS class_id FROM r GROUP BY id),
l AS (SELECT a AS id, sum(copies) AS links FROM p GROUP BY a)
SELECT doc_id, k.class_id, CAST(coalesce(l.links, 0) + c.copies - 1 AS BIGINT) AS n_links, c.copies AS n_copies
FROM s JOIN c ON list_sort(s.g) = c.g JOIN k ON k.id = c.id LEFT JOIN l ON l.id = c.id"""
