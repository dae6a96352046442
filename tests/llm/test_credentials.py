"""Secret scans: rules against plain patterns, inferred formats on held-out credentials."""

import hashlib
import math
import os
import random
import re
import string
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hard import SCHEMA, frame, hard_documents, prose

from emberlog.llm import credentials

PATTERNS = {
    "assign": (re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16), "hex": (re.compile(r"[0-9a-f]+"), 0, 32)}


def brute(text):
    found = [(m.start(), list(PATTERNS).index(kind), m.end()) for kind, (pattern, group, least) in PATTERNS.items()
             for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return [f"{list(PATTERNS)[k]}:{a}:{b}" for a, k, b in sorted(found)]


def drawn(rng, letters, n):
    return "".join(rng.choice(letters) for _ in range(n))


FORMATS = {"assign": [lambda r: "ghx_" + drawn(r, string.ascii_letters + string.digits, 30), lambda r: drawn(r, "0123456789ABCDEF", 40)],
           "access": [lambda r: "AKIA" + drawn(r, string.ascii_uppercase + string.digits, 16)]}


def secret_documents():
    """Labelled credentials of three formats; the same formats without a rule's words; numbers, names and words."""
    rng = random.Random(8)
    rows, bare = [], {}
    for i in range(900):
        text = f"{prose(rng, 20)} mail{i}@host{i}.example.org {rng.randrange(10**16)} 10.0.{i % 256}.{i % 7} internationalisation_{i % 30}"
        if i < 500:
            text += rng.choice([f' token = "{FORMATS["assign"][0](rng)}"', f" API_KEY:{FORMATS['assign'][1](rng)} ", f" {FORMATS['access'][0](rng)}, "])
        elif i < 700:
            bare[i] = FORMATS["assign"][i % 2](rng)
            text += f" é日🙂 ({bare[i]})."
        rows.append((i, text))
    return rows, bare


def edge_documents():
    made = ["token=token=abcdefgh", "token=secret:abcdefghij", "PASSWORD : '12345678'", "toKen=abcdefgh", "paſſword=abcdefgh",
            "AKIA" + "A" * 11, "AKIAAKIA" + "B" * 8, "é" * 5 + "a" * 32 + "🙂" + "b" * 31, "token=" + "f" * 64 + " api_key==" + "e" * 9,
            "token=\x00abcdefgh", "secret", "=abcdefgh", "passwd\"=\"../../..", "token=........", "x" * 200_000, "a" * 200_000, "token =", "token = ", "abcdefgh"]
    return [(2000 + i, t) for i, t in enumerate(made)] + hard_documents()


def test_rules_against_patterns(spark, ws):
    rows = edge_documents()
    got = credentials.query(frame(spark, rows), ws).collect()
    want = []
    for doc, text in rows:
        base = brute(text)
        many = [sum(b.startswith(k) for b in base) for k in PATTERNS]
        want.append((doc, *many, hashlib.sha256(",".join(base).encode()).hexdigest()))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    text = dict(rows)
    for r in got:
        if r.doc_id is not None and list(d for d, _ in rows).count(r.doc_id) == 1:
            assert set(brute(text[r.doc_id])) <= set(filter(None, r.spans.split(",")))


def test_formats_are_learned(spark, ws):
    rows, bare = secret_documents()
    docs = frame(spark, rows)
    spans = {r.doc_id: r.spans for r in credentials.query(docs, ws).collect()}
    text = dict(rows)
    caught = 0
    for i, value in bare.items():
        at = text[i].index(value)
        caught += f"assign:{at}:{at + len(value)}" in spans[i].split(",")
    assert caught >= 0.95 * len(bare)
    for i, found in spans.items():
        more = set(filter(None, found.split(","))) - set(brute(text[i]))
        assert len(more) <= (i in bare), (i, more)


def test_no_examples_no_formats(spark, ws):
    rng = random.Random(1)
    rows = [(i, prose(rng, 40) + " longerwords" + str(i)) for i in range(30)]
    assert {r.spans for r in credentials.query(frame(spark, rows), ws).collect()} == {""}
    assert credentials.query(spark.createDataFrame([], SCHEMA), ws).collect() == []


def test_automaton_knows_letters_and_length():
    rng = random.Random(3)
    made = [b"ab_" + drawn(rng, "0123456789", 12).encode() for _ in range(400)]
    model = credentials.infer(made)
    # One state a level: equal continuations are one state.
    assert model.next.shape[0] == model.depth == 16
    held = [b"ab_" + drawn(rng, "0123456789", 12).encode() for _ in range(100)]
    other = [b"ab_" + drawn(rng, "0123456789", 11).encode(), b"ac_" + drawn(rng, "0123456789", 12).encode(), b"ab_" + drawn(rng, "abcdefghij", 12).encode()]
    def score(texts):
        data = np.frombuffer(b"".join(texts), np.uint8)
        high = np.cumsum([len(t) for t in texts])
        return model.score(data, high - [len(t) for t in texts], high)
    likely, excess = score(held)
    assert (excess <= model.limit).all() and abs(likely.mean() + 12 * math.log(10)) < 1.5
    assert (score(other)[1] > model.limit).all()
    # Chances of all continuations of a state make one.
    assert np.allclose(np.exp(model.chance).sum(1) + np.exp(model.ends), 1)


def test_examples_are_the_lowest_hashes(spark, monkeypatch):
    rows, _ = secret_documents()
    docs = frame(spark, rows)
    every = {(r.label, r.hash, bytes(r.value)) for r in credentials.examples(docs, 10**6).collect()}
    some = {(r.label, r.hash, bytes(r.value)) for r in credentials.examples(docs, 5).collect()}
    assert some <= every
    for label in {e[0] for e in every}:
        lowest = sorted((h % (1 << 64), v) for l, h, v in every if l == label)[:5]
        assert {v for _, v in lowest} <= {v for l, _, v in some if l == label}
    assert b"ghx_" in {v[:4] for l, _, v in every if l == "assign"}


def scored(model, text):
    """A token's log likelihood and excess, symbol by symbol."""
    state, total, excess = 0, 0.0, 0.0
    for byte in text:
        symbol = credentials._NUMBER[byte]
        total += model.chance[state, symbol]
        excess += math.inf if model.never[state, symbol] else -model.chance[state, symbol] - model.expected[state]
        state = model.next[state, symbol]
    excess += math.inf if model.never_ends[state] else -model.ends[state] - model.expected[state]
    return total + model.ends[state], excess


def test_tokens_beyond_the_deepest_state_are_candidates():
    rng = random.Random(0)
    letters = string.ascii_letters + string.digits
    words = sorted({drawn(rng, string.ascii_lowercase, rng.randrange(8, 16)).encode() for _ in range(2000)})
    made = sorted(drawn(rng, letters, rng.randrange(30, 60)).encode() for _ in range(3))
    models = {"assign": credentials.infer(made), credentials.ORDINARY: credentials.infer(words)}
    # In a state that follows itself the rest counts at once: many tokens, and one beyond what is tallied with others.
    tokens = [e + drawn(rng, letters, n).encode() for e in made for n in range(40)] + [w + b"x" * n for w in words[:5] for n in (0, 30, 300)]
    tokens += [b"abcdefgh" * n for n in (1, 90, 900)] + [drawn(rng, letters, 200).encode() for _ in range(700)]
    found = credentials.Scanned(np.frombuffer(b" ".join(tokens), np.uint8), np.array([0, len(b" ".join(tokens))]))
    low = np.cumsum([0] + [len(t) + 1 for t in tokens[:-1]])
    assert found.low.tolist() == low.tolist()
    want = []
    for at, token in zip(low.tolist(), tokens):
        (likely, excess), (usual, _) = (scored(models[k], token) for k in ("assign", credentials.ORDINARY))
        got = [m.score(found.data, np.array([at]), np.array([at + len(token)])) for m in models.values()]
        assert np.allclose([x[0] for x in got[0]] + list(got[1][0]), [likely, excess, usual])
        if excess <= models["assign"].limit and likely - usual >= math.log(credentials.ODDS):
            want.append((0, at, at + len(token)))
    assert list(zip(*(x.tolist() for x in credentials.matches(found, models)))) == want
    assert any(b - a > models["assign"].depth + 8 for _, a, b in want)


def test_formats_of_any_length_are_learned(spark, ws):
    rng = random.Random(5)
    rows, bare = [], {}
    for i in range(400):
        value = "tk." + drawn(rng, string.ascii_letters + string.digits, rng.randrange(150, 6000 if i % 50 == 0 else 400))
        text = f"{prose(rng, 20)} internationalisation_{i % 30} mail{i}@host{i}.example.org {rng.randrange(10**16)}"
        if i < 300:
            text += f' token = "{value}"'
        elif i < 350:
            bare[i] = value
            text += f" é ({value})."
        else:
            # Of equal length, but for one sign.
            text += " " + value.replace("tk.", "tk-")
        rows.append((i, text))
    text = dict(rows)
    more = {r.doc_id: set(filter(None, r.spans.split(","))) - set(brute(text[r.doc_id])) for r in credentials.query(frame(spark, rows), ws).collect()}
    caught = sum(more[i] == {f"assign:{text[i].index(v)}:{text[i].index(v) + len(v)}"} for i, v in bare.items())
    assert caught >= 0.95 * len(bare), caught
    assert not any(found for i, found in more.items() if i not in bare)


def test_long_examples_keep_all_their_symbols(spark):
    rng = random.Random(6)
    values = [drawn(rng, string.ascii_uppercase, n) for n in (100, 128, 129, 700, 20_000)]
    got = [r for r in credentials.examples(frame(spark, [(i, f"token={v}") for i, v in enumerate(values)])).collect() if r.label == "assign"]
    tails = {bytes(r.value): t for r, t in zip(got, credentials._tails([bytes(r.tail) for r in got]).tolist())}
    assert tails == {v[:128].encode(): [v[128:].count(chr(s)) for s in credentials._SYMBOLS] for v in values}
