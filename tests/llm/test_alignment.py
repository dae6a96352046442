"""Alignment of two tokenizers against both libraries and a comparison of all token ends."""

import hashlib
import os
import random
import sys
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hard import SCHEMA, frame, hard_documents, prose

from emberlog.llm import alignment, hashing

BYTE, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
LETTERS = alignment._letters()


def odd_documents():
    rng = random.Random(3)
    signs = [" ", "  ", "\n", "\t", "\r\n", "a", "the", "é", "日本", "🙂", "<s>", "<|endoftext|>", "▁", "\x00", " ", "ﬁ", "don't", "12", "!!", " "]
    made = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 40))) for _ in range(150)]
    return hard_documents() + [(1000 + i, t) for i, t in enumerate(made)] + [(1, "▁"), (2, "a▁ b"), (3, " ▁"), (None, "a b"), (5, "\n"), (6, " ")]


def brute(rows):
    """The contract's columns from the libraries alone."""
    byte, piece = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    byte.encode_special_tokens = True
    spelled = lambda p, i: bytes([int(p[3:5], 16)]) if piece.is_byte(i) else p.replace("▁", " ").encode()
    out, count = [], Counter()
    for doc, text in rows:
        text = text or ""
        one = byte.encode(" " + text, add_special_tokens=False) if text else None
        a = [(i, bytes(LETTERS[c] for c in t)) for i, t in zip(one.ids, one.tokens)] if text else []
        b = [(i, spelled(piece.id_to_piece(i), i)) for i in piece.encode(text)] if text else []
        if any(b"".join(t for _, t in x) != (" " + text).encode() for x in (a, b)):
            a = b = []
        ends = lambda x: np.cumsum([len(t) for _, t in x]).tolist()
        a_end, b_end = ends(a), ends(b)
        both = sorted(set(a_end) & set(b_end))
        a_at, b_at = ({e: i for e, (i, _) in zip(ends, side)} for ends, side in ((a_end, a), (b_end, b)))
        links = [(a_at[e], b_at[e]) for e in both]
        groups, low_a, low_b = [], 0, 0
        for e in both:
            high_a, high_b = a_end.index(e, low_a) + 1, b_end.index(e, low_b) + 1
            groups.append(",".join(str(i) for i, _ in a[low_a:high_a]) + "|" + ",".join(str(i) for i, _ in b[low_b:high_b]))
            low_a, low_b = high_a, high_b
        count.update(links)
        out.append((doc, len(a), len(b), groups, links))
    best = Counter()
    for (_, i), n in count.items():
        best[i] = max(best[i], n)
    return sorted(((doc, n_a, n_b, len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links),
                    hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for doc, n_a, n_b, groups, links in out), key=repr)


@pytest.mark.parametrize("most", [alignment.PAIR_ROWS, 40])
def test_alignment_against_the_libraries(spark, ws, monkeypatch, most):
    monkeypatch.setattr(alignment, "PAIR_ROWS", most)
    rows = odd_documents()
    got = alignment.query(frame(spark, rows), BYTE, PIECE, ws)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_groups_are_the_real_tokens(spark):
    rows = odd_documents()
    want = {(r[0], r[7]) for r in brute(rows)}
    for r in alignment.aligned(frame(spark, rows), BYTE, PIECE).collect():
        a, b, groups = list(r.a_ids), list(r.b_ids), []
        for n, m in zip(r.a_sizes, r.b_sizes):
            groups.append(",".join(map(str, a[:n])) + "|" + ",".join(map(str, b[:m])))
            a, b = a[n:], b[m:]
        assert not a and not b
        assert (r.doc_id, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") in want


def test_common_ends_on_random_cuts():
    rng = np.random.default_rng(2)
    for share in (0.02, 0.3, 0.9):
        rows = []
        for _ in range(30):
            n = int(rng.integers(1, 400))
            rows.append([np.append(np.flatnonzero(rng.random(n - 1) < share) + 1, n) if n > 1 else np.array([1]) for _ in range(2)])
        base = np.concatenate([[0], np.cumsum([r[0][-1] for r in rows])])[:-1]
        a, b = (np.concatenate([r[k] + s for r, s in zip(rows, base)]) for k in range(2))
        got = alignment.common_ends(a, b, np.array([len(r[0]) for r in rows]), np.array([len(r[1]) for r in rows]))
        both = np.intersect1d(a, b)
        assert a[got[0]].tolist() == both.tolist() == b[got[1]].tolist()


def test_common_ends_far_from_the_middle():
    """The only shared cut is the first end; the rest of a long interval has none."""
    a, b = np.append(np.arange(2, 2000, 2), 2001), np.concatenate([[2], np.arange(3, 2000, 2), [2001]])
    got = alignment.common_ends(a, b, np.array([len(a)]), np.array([len(b)]))
    assert a[got[0]].tolist() == [2, 2001]


def test_piece_chunks_are_the_library_s():
    coder, library = alignment.PieceBpe(PIECE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = [t for _, t in odd_documents() if t]
    ids, counts = coder.encode(*hashing.buffers(pa.array([" " + t for t in texts])))
    at = np.concatenate([[0], np.cumsum(counts)])
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library.encode(t) for t in texts]


def test_no_documents(spark, ws):
    nothing = spark.createDataFrame([], SCHEMA)
    assert alignment.query(nothing, BYTE, PIECE, ws).collect() == []
    assert alignment.aligned(nothing, BYTE, PIECE).collect() == []
