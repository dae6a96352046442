"""Periodic runs against a comparison of all words at all distances."""

import hashlib
import os
import random
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hard import SCHEMA, frame, hard_documents

from emberlog.llm import periods


def brute_runs(words, least=6, exponent=4):
    """(start, length, period) by comparing words q apart, for all q; a shorter period of the same stretch wins."""
    n, out = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, exponent * q):
                inner = words[i:i + length]
                if not any(inner[:-p] == inner[p:] for p in range(1, q)):
                    out[i, length, q] = None
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def edited(doc, words):
    h, n = zlib.crc32(str(doc).encode()), len(words)
    if doc is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def brute(rows):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    out = []
    for doc, text in rows:
        words = edited(doc, (text or "").encode().split())
        runs = brute_runs(words)
        dropped = {k for s, n, q in runs for k in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        out.append((doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()),
                    sha(b" ".join(w for i, w in enumerate(words) if i not in dropped))))
    return sorted(out, key=repr)


def periodic_documents():
    """Random words from few, repeated blocks inside others, and runs that touch and overlap."""
    rng = random.Random(9)
    rows = []
    for i in range(400):
        letters = "abcdefgh"[:rng.randrange(1, 9)]
        words = [rng.choice(letters) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(4)):
            block = [rng.choice(letters) for _ in range(rng.randrange(1, 9))]
            at = rng.randrange(len(words) + 1)
            many = rng.randrange(2, 9)
            words[at:at] = (block * many)[:len(block) * many - rng.randrange(len(block))]
        rows.append((i * 10 if rng.random() < 0.7 else None, rng.choice([" ", "\n", " \t"]).join(words)))
    return rows


def test_runs_of_sequences():
    rng = random.Random(4)
    for _ in range(500):
        block = [rng.randrange(1, 4) for _ in range(rng.randrange(1, 7))]
        seq = [rng.randrange(1, 4) for _ in range(rng.randrange(12))] + block * rng.randrange(1, 6) + [rng.randrange(1, 4) for _ in range(rng.randrange(12))]
        for least, exponent in ((6, 4), (2, 2), (5, 3)):
            assert [tuple(r) for r in periods.find_runs(seq, least, exponent).tolist()] == brute_runs(seq, least, exponent)


def test_extensions():
    rng = random.Random(6)
    seq = [rng.randrange(1, 3) for _ in range(300)] + [1] * 200 + [2, 1] * 60
    tree = periods.SuffixTree(seq)
    i, j = np.array([(a, b) for a in range(0, 621, 7) for b in range(621) if a != b]).T
    def common(a, b):
        k = 0
        while max(a, b) + k < len(seq) and seq[a + k] == seq[b + k]:
            k += 1
        return k
    assert tree.extension(i, j).tolist() == [common(a, b) for a, b in zip(i.tolist(), j.tolist())]
    assert tree.suffixes == sorted(range(len(seq) + 1), key=lambda k: seq[k:])
    assert tree.reverse_order() == sorted(range(len(seq) + 1), key=lambda k: [-x for x in seq[k:]])


@pytest.mark.parametrize("make", [periodic_documents, hard_documents])
def test_query_against_all_distances(spark, make):
    rows = make()
    assert sorted(map(tuple, periods.query(frame(spark, rows)).collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("least, exponent", [(6, 4), (2, 2), (9, 3)])
def test_runs_and_collapsed_texts(spark, least, exponent):
    rows = periodic_documents()
    got = periods.periodic_runs(frame(spark, rows), least, exponent).collect()
    want = []
    for doc, text in rows:
        words = text.split()
        runs = brute_runs(words, least, exponent)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((doc, [list(r) for r in runs], " ".join(w for i, w in enumerate(words) if i not in gone)))
    assert sorted(((r.doc_id, [list(x) for x in r.runs], r.collapsed) for r in got), key=repr) == sorted(want, key=repr)


def test_long_texts_and_no_rows(spark):
    rng = random.Random(2)
    block = [f"w{rng.randrange(10**6)}" for _ in range(20_000)]
    text = " ".join(["start"] + block * 5 + ["end"] + ["a"] * 60_000)
    one = periods.periodic_runs(spark.createDataFrame([(None, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in one.runs] == [(1, 100_000, 20_000), (100_002, 60_000, 1)]
    assert one.collapsed == " ".join(["start", *block, "end", "a"])
    assert periods.query(spark.createDataFrame([], SCHEMA)).collect() == []
