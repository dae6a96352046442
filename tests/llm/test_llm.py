"""Operators of the training-data pipeline against brute force, on documents made to be hard."""

import hashlib
import os
import random
import sys
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hard import SCHEMA, frame, hard_documents, prose

from emberlog.llm import (chat, encoder, fingerprint, hashing, jaccard, lines, packing, pieces, quality,
                          substrings, toxicity, wavelet)

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ROWS = hard_documents()


@pytest.fixture(scope="module")
def hard(spark):
    docs = frame(spark, ROWS).cache()
    docs.count()
    return docs


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    table = pa.table({"doc_id": pa.array([i for i, _ in ROWS], pa.int64()), "text": pa.array([t for _, t in ROWS])})
    con.register("documents", table)
    return con


def same_as_sql(df, duck, sql):
    names = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*names).collect()), key=repr)
    found = duck.execute(sql)
    at = [[d[0] for d in found.description].index(n) for n in names]
    want = sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)
    assert got == want


# ---- queries against SQL, on nulls, empty and long texts, ties, repeated rows and clashing names -------------------


def test_fingerprints_as_sql(hard, duck):
    same_as_sql(fingerprint.query(hard), duck, fingerprint.SQL)


def test_fingerprints_over_many_ranges(hard, duck, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 4)
    same_as_sql(fingerprint.query(hard), duck, fingerprint.SQL)


def test_lines_as_sql(hard, duck, ws):
    same_as_sql(lines.query(hard, ws), duck, lines.SQL)


def test_lines_beyond_the_broadcast_limit(hard, duck, ws, small_limits):
    same_as_sql(lines.query(hard, ws), duck, lines.SQL)


def test_quality_as_sql(hard, duck):
    same_as_sql(quality.query(hard), duck, quality.SQL)


def brute_links(rows):
    """(doc_id, class_id, n_links, n_copies) by comparing all pairs."""
    def grams(t):
        w = (t or "").encode().split()
        return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [grams(t) for _, t in rows]
    near = [[j for j, b in enumerate(sets) if j != i and (a == b or (a | b and len(a & b) / len(a | b) >= 0.8))]
            for i, a in enumerate(sets)]
    out = []
    for i, (doc, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((doc, min(ids, default=None), len(near[i]), sum(s == sets[i] for s in sets)))
    return sorted(out, key=repr)


def test_jaccard_against_all_pairs(hard, ws):
    assert sorted((tuple(r) for r in jaccard.query(hard, ws).collect()), key=repr) == brute_links(ROWS)


def test_jaccard_in_blocks_and_without_broadcast(hard, ws, monkeypatch, small_limits):
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    assert sorted((tuple(r) for r in jaccard.query(hard, ws).collect()), key=repr) == brute_links(ROWS)


def test_jaccard_bayes_rule():
    """A pair at the threshold is dropped with a chance below the tolerance at every step."""
    import math
    for n, least in jaccard.least_matches(0.8):
        below = sum(math.comb(n + 1, m) * 0.8**m * 0.2 ** (n + 1 - m) for m in range(least))
        assert below < jaccard.TOLERANCE
    assert jaccard.least_matches(0.8)[-1][1] > 100


# ---- substrings ------------------------------------------------------------------------------------------------------


def brute_repeats(rows):
    """What is left of every text, by going over all windows in corpus order."""
    order = sorted({(-1 << 63 if i is None else i, t or "") for i, t in rows})
    seen, out = set(), {}
    by_id = {}
    for i, t in order:
        by_id.setdefault(i, []).append(t)
    assert all(len(v) == 1 or i < 0 for i, v in by_id.items())
    for i, t in order:
        data = t.encode()
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - 99):
            window = data[at:at + 100]
            if window in seen:
                gone[at:at + 100] = True
            seen.add(window)
        left = bytes(np.frombuffer(data, np.uint8)[~gone])
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out[i, t] = (len(data), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())
    return out


def unique_ids(rows):
    """Rows of one id have one text here: the order of two texts of one id is by a hash."""
    return [(i, t) for i, t in rows if i is not None] + [(None, "no id here")]


def passages(n):
    """Documents with one passage between texts of their own, so that triggers at its edges have many phrases; and copies."""
    rng = random.Random(9)
    shared = prose(rng, 40)
    rows = [(i, prose(rng, 3 + i % 20) + shared[:200 + i % 30] + prose(rng, 5 + i % 9)) for i in range(n)]
    return rows + [(n + i, rows[i % 5][1]) for i in range(40)]


@pytest.mark.parametrize("most, batch", [(0, 3), (2, 5), (7, 10_000), (8192, 4)])
def test_substrings_of_triggers_beyond_the_bound(spark, ws, monkeypatch, most, batch):
    """Triggers that no sample names are counted where they are resolved, also when they span batches."""
    monkeypatch.setattr(substrings, "HOT_SEEN", 1 << 30)
    monkeypatch.setattr(substrings, "MOST", most)
    rows = passages(150)
    want = brute_repeats(rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = substrings.remove(frame(spark, rows), ws, "cut").select("doc_id", "text", "cut").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(rows)
    for r in got:
        assert (r.cut.n_bytes, r.cut.n_removed, r.cut.n_spans, r.cut.kept_sha256) == want[r.doc_id, r.text]


@pytest.mark.parametrize("most", [0, 1, 4, 100])
def test_parts_of_keys(most):
    """Every row once and in order; unmarked tables hold whole keys, and marked ones a single key of more rows than the bound."""
    rng = random.Random(most)
    keys = sorted(rng.choice([-5, 0, 1, 1, 1, 1, 2, 9]) for _ in range(200))
    for size in (1, 3, 7, 200):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[i:i + size], pa.int64())], names=["k"]) for i in range(0, 200, size)]
        parts = [(t.column(0).to_pylist(), part) for t, part in substrings._key_parts(iter([batches[0].slice(0, 0), *batches]), most)]
        assert [k for part, _ in parts for k in part] == keys
        for held, part in parts:
            assert held and (not part or (len(set(held)) == 1 and keys.count(held[0]) > most))
            if not part:
                assert all(held.count(k) == keys.count(k) for k in set(held))
        assert max(len(held) for held, _ in parts) <= most + 2 * size


@pytest.mark.parametrize("hot", [False, True])
def test_substrings_against_all_windows(spark, ws, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(substrings, "SAMPLE", 1)
        monkeypatch.setattr(substrings, "HOT_SEEN", 0)
    rows = unique_ids(ROWS)
    want = brute_repeats(rows)
    got = substrings.remove(frame(spark, rows), ws, "cut").select("doc_id", "text", "cut").collect()
    assert len(got) == len(rows)
    for r in got:
        key = (-1 << 63 if r.doc_id is None else r.doc_id, r.text or "")
        assert (r.cut.n_bytes, r.cut.n_removed, r.cut.n_spans, r.cut.kept_sha256) == want[key]


def test_substrings_of_a_text_longer_than_a_piece(spark, ws, monkeypatch):
    split = substrings._split
    monkeypatch.setattr(substrings, "_split", lambda data, offsets: split(data, offsets, 300))
    rng = random.Random(3)
    long = prose(rng, 900, 3000)
    rows = [(1, long), (2, prose(rng, 40) + long[500:3000] + "z"), (3, long[100:180])]
    want = brute_repeats(rows)
    # The split works in the driver's process here: parse all rows as a task would.
    data, offsets = hashing.buffers(pa.array([t for _, t in rows]))
    found = [(rows_[row], start + shift[row], n) for rows_, part, at, shift in substrings._split(data, offsets)
             for row, start, n, *_ in [substrings.parse(part, at)]]
    windows = sorted((r, s + k) for a, b, c in found for r, s, n in zip(a, b, c) for k in range(n))
    assert windows == [(r, s) for r, (_, t) in enumerate(rows) for s in range(max(0, len(t) - 99))]
    assert want[2, rows[1][1]][1] == 2500


# ---- tokens ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_gives_the_librarys_ids(path):
    texts = [t for _, t in ROWS] + ["a<|endoftext|>b <|startoftext|>", "tab\t\t x y   z", "it's I'LL  'S"]
    coder = encoder.Encoder(path)
    for _ in range(2):
        ids, counts = coder.encode(*hashing.buffers(pa.array(texts)))
        want = [Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("shard", [wavelet.SHARD_TOKENS, 300])
def test_wavelet_files_against_the_library(spark, hard, ws, shard):
    folder = ws.path("tokens")
    wavelet.write_tokens(hard, BYTE, folder, ws, shard_tokens=shard)
    files = spark.read.parquet(folder)
    got = [tuple(r) for r in wavelet.read_documents(files).orderBy("start").collect()]
    coder, start, want, stream = Tokenizer.from_file(BYTE), 0, [], []
    for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = coder.encode(t or "", add_special_tokens=False).ids + [wavelet.END]
        want.append((i, start, len(ids), crc(ids)))
        stream += ids
        start += len(ids)
    assert got == want
    token = stream[7]
    found = wavelet.occurrences(files, token).collect()
    assert sum(r["count"] for r in found) == stream.count(token) == sum(len(r.places) for r in found)


def test_wavelet_matrix():
    rng = np.random.default_rng(0)
    for size in (0, 1, 4096, 20_001):
        tokens = rng.integers(0, 700, size).astype(np.uint16)
        matrix = wavelet.WaveletMatrix.build(tokens, 10)
        assert (matrix.tokens() == tokens).all()
        for place in {0, size // 2, size - 1} if size else ():
            assert matrix.access(place) == tokens[place]
        for token in (0, 5, 699, 5000):
            for end in (0, size // 3, size):
                assert matrix.rank(token, end) == int((tokens[:end] == token).sum())
            assert matrix.locate(token).tolist() == np.flatnonzero(tokens == token).tolist()


def test_packing_holds_every_piece_once(hard, ws):
    got = packing.query(hard, WORD, ws).collect()
    coder, want = Tokenizer.from_file(WORD), []
    for i, t in ROWS:
        ids = coder.encode(t or "", add_special_tokens=False).ids + [packing.END]
        want += [(i, at // 2048, at, len(ids[at:at + 2048]), crc(ids[at:at + 2048])) for at in range(0, len(ids), 2048)]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        ends = np.cumsum([0] + [n for _, n in sorted(parts)])
        assert [a for a, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= 2048
    assert len(sequences) <= -(-sum(r.length for r in got) // 2048) + 1


@pytest.mark.parametrize("kind", ["wide", "narrow", "one", "none"])
def test_configurations_hold_the_demand(kind):
    rng = np.random.default_rng(2)
    demand = np.zeros(257, np.int64)
    if kind == "wide":
        demand += np.bincount(rng.integers(1, 257, 50_000), minlength=257)
    elif kind == "narrow":
        demand += np.bincount(rng.integers(80, 140, 5_000), minlength=257)
    elif kind == "one":
        demand[100] = 7
    made = packing.configurations(demand)
    held = np.zeros_like(demand)
    for config, times in made:
        assert sum(config) <= 256 and times > 0
        for item in config:
            held[item] += times
    assert (held == demand).all()
    used = sum(n for _, n in made)
    plain = sum(n for _, n in packing._best_fit(demand.copy()))
    assert used <= 1.005 * plain + 1 and used >= -(-int((demand * np.arange(257)).sum()) // 256)


@pytest.mark.parametrize("kind", ["mix", "uniform"])
def test_configurations_need_no_more_than_best_fit(kind):
    rng = np.random.default_rng(4)
    mix = np.concatenate([rng.integers(163, 189, 5000), rng.integers(50, 114, 5000)])
    demand = np.bincount(mix if kind == "mix" else rng.integers(1, 257, 20_000), minlength=257)
    assert sum(n for _, n in packing.configurations(demand)) <= sum(n for _, n in packing._best_fit(demand.copy()))


# ---- SentencePiece ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return pieces.load(public_tokenizers.path("piece_bpe_32k.model"))


def scalar_viterbi(text, model, known, unknown):
    """Best segmentation of one text, character by character."""
    text = (pieces.SPACE + text.replace(" ", pieces.SPACE)) if text else ""
    best = [(0.0, 0, 0)]
    for end in range(1, len(text) + 1):
        top = (-np.inf, 0, 0)
        for size in range(1, min(16, end) + 1):
            id_ = known.get(text[end - size:end])
            if id_ is not None and best[end - size][0] + model.scores[id_] >= top[0]:
                top = (best[end - size][0] + model.scores[id_], size, id_)
        if text[end - 1] not in known and best[end - 1][0] + unknown > top[0]:
            top = (best[end - 1][0] + unknown, 1, -1)
        best.append(top)
    out, end = [], len(text)
    while end:
        _, size, id_ = best[end]
        out[:0] = [id_] if id_ >= 0 else [model.bytes_[b] for b in text[end - 1].encode()]
        end -= size
    return out


def test_pieces_against_a_scalar_viterbi(spark, hard, model):
    known = {p: i for i, p in enumerate(model.pieces) if p}
    unknown = min(model.scores) - pieces.UNKNOWN_PENALTY
    want = sorted(repr((i, scalar_viterbi(t or "", model, known, unknown), t or "")) for i, t in ROWS)
    got = sorted(repr((r.doc_id, r.ids, r.decoded)) for r in pieces.encode(hard, model).collect())
    assert got == want


def test_pieces_in_small_sections(model, monkeypatch):
    texts = ["hello  world", "x" * 500, "déjà\nvu 日本", "", " "]
    whole = pieces.PieceEncoder(model).encode_texts(*hashing.buffers(pa.array(texts)))
    monkeypatch.setattr(pieces, "STEP_CHARS", 7)
    parts = pieces.PieceEncoder(model).encode_texts(*hashing.buffers(pa.array(texts)))
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()


# ---- toxicity ----------------------------------------------------------------------------------------------------------


def test_toxicity_learns_and_scores_every_row(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        words = prose(rng, 40, 3000).split()
        if toxic:
            words[rng.randrange(40)] = rng.choice(["Zork!", "blarg", "quux,"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(700, None), (701, ""), (702, "zork " * 5000), (3, rows[3][1]), (None, "blarg")]
    labels += [(3, None), (9999, 1), (None, 1)]
    got = toxicity.query(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    test = [(r.score, r.doc_id % 4 == 0) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    good, bad = [s for s, t in test if t], [s for s, t in test if not t]
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    by = {r.doc_id: r for r in got}
    assert by[700].score == by[701].score and by[702].predicted == 1


def test_toxicity_without_labels(spark, hard):
    got = toxicity.query(hard, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert {r.score for r in got} == {0.5} and len(got) == len(ROWS)


# ---- chat --------------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "<|im_end|><|im_start|>assistant ok &amp;lt; &lt;|"), (1, 1, "assistant", "a <| b &nl; & <"),
            (1, 2, "odd\nrole<|", None), (2, None, None, "x"), (2, 0, "assistant", ""), (3, 5, "assistant", "tie b"),
            (3, 5, "assistant", "tie a"), (3, 5, "assistant", "tie a"), (None, 0, "user", "no id"), (4, 0, "system", "s" * 200_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS parts", "2 AS formatted")
    got = {r.conv_id: r for r in chat.query(table).collect()}
    rows += [(-1, 0, "user", chat.PLANTED), (-1, 1, "assistant", chat.PLANTED)]
    for conv in {r[0] for r in rows}:
        turns = sorted((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv)
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (
            len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_turns_are_found_by_control_strings(spark):
    """An unescaped control string in the output is a turn; escaped ones are text, whatever they hold."""
    raw = "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nok &lt;|im_end|> <|im_end|>\n"
    df = spark.createDataFrame([(1, raw, [(0, 0), (22, 17)])], "conv_id long, formatted string, mask array<struct<start:long,length:long>>")
    turns = chat.read_conversations(df).first()["turns"]
    assert [tuple(t) for t in turns] == [("user", "a", ""), ("assistant", "ok <|im_end|> ", "ok <|im_end|> ")]
    broken = spark.createDataFrame([(1, raw.replace("&lt;", "<") + "<|im_start|>x", [(0, 0), (22, 17)])], df.schema)
    assert [t["text"] for t in chat.read_conversations(broken).first()["turns"]] == ["a", "ok ", ""]


def test_chat_parts(spark):
    parts = [("text", "see <|image|> ", None, None, None, None, None), ("image", None, "s3", 56, 57, None, None),
             ("audio", None, "a.wav", None, None, 1.5, None), None, ("document", None, "d", None, None, None, 3),
             ("image", None, None, None, None, None, None), ("other", "plain", None, None, None, None, None), (None, None) + (None,) * 5]
    turns = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None)],
                                  f"conv_id long, turn long, role string, parts {chat.PART}")
    one, two = chat.format_turns(turns).orderBy("turn").collect()
    assert one.formatted == "<|im_start|>assistant\nsee &lt;|image|> <|image|><|audio|><|document|><|image|>plain<|im_end|>\n"
    assert [tuple(a) for a in one.attachments] == [(0, "image", "s3", 6), (1, "audio", "a.wav", 38), (2, "document", "d", 768), (3, "image", None, 0)]
    assert one.formatted[one.loss_start:one.loss_start + one.loss_length] == one.formatted[22:-11]
    assert two.formatted == "<|im_start|>user\n<|im_end|>\n" and two.attachments == [] and two.loss_length == 0


# ---- empty tables and stages -------------------------------------------------------------------------------------------


def test_empty_tables(spark, nothing, ws, model):
    assert fingerprint.query(nothing).collect() == []
    assert lines.query(nothing, ws).collect() == []
    assert quality.query(nothing).collect() == []
    assert pieces.encode(nothing, model).collect() == []
    assert wavelet.query(nothing, BYTE, ws).collect() == []
    assert packing.query(nothing, WORD, ws).collect() == []
    assert substrings.query(nothing, ws).collect() == []
    assert jaccard.query(nothing, ws).collect() == []
    assert toxicity.query(nothing, spark.createDataFrame([], "doc_id long, toxic int")).collect() == []
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [r.conv_id for r in chat.query(empty).collect()] == [-1]


def test_stages_keep_all_columns(hard, ws):
    for stage in (quality.stage, lambda d: lines.stage(d, ws), lambda d: jaccard.stage(d, ws), lambda d: substrings.stage(d, ws)):
        left = stage(hard)
        assert left.columns == hard.columns
        first = left.filter("doc_id = 0").first()
        assert first is None or first["h1"] == "h1-0"


def test_near_stage_leaves_one_row_per_group(hard, ws):
    kept = sorted(r.doc_id for r in jaccard.stage(hard, ws).collect() if r.doc_id is not None)
    assert kept == sorted({c for _, c, _, _ in brute_links(ROWS) if c is not None})


def brute_kept(rows):
    """(doc_id, text) of the least row, by id and text, of each group of near copies."""
    def grams(t):
        w = (t or "").encode().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, group = [grams(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                group = [group[i] if g == group[j] else g for g in group]
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    return sorted((min((r for r, g in zip(rows, group) if g == own), key=order) for own in set(group)), key=repr)


def unnamed_documents():
    """Texts without an id, ids with unrelated texts, and near copies among both."""
    rng = random.Random(11)
    base, other = prose(rng, 120, 4000), prose(rng, 120, 4000)
    rows = [(3, base), (7, prose(rng, 50, 4000)), (7, base + " tail"), (None, base + " end"), (None, other + " z"), (None, other),
            (None, other + " z"), (9, prose(rng, 40, 4000)), (9, prose(rng, 40, 4000)), (12, prose(rng, 30, 4000)), (12, None)]
    alone = prose(rng, 80, 4000)
    rows += [(None, prose(rng, 60, 4000)) for _ in range(6)] + [(5, alone), (5, alone), (5, alone + " more")]
    return rows + [(None, f"{alone} {i}") for i in range(3)]


@pytest.mark.parametrize("make", [unnamed_documents, hard_documents])
def test_near_stage_keeps_every_document_without_a_near_copy(spark, ws, make):
    rows = make()
    got = jaccard.stage(frame(spark, rows), ws).select("doc_id", "text").collect()
    assert sorted(((r.doc_id, r.text or "") for r in got), key=repr) == sorted(((i, t or "") for i, t in brute_kept(rows)), key=repr)


def test_near_stage_of_unnamed_documents_without_broadcast(spark, ws, monkeypatch, small_limits):
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    rows = unnamed_documents()
    assert sorted(map(tuple, jaccard.stage(frame(spark, rows), ws).select("doc_id", "text").collect()), key=repr) == brute_kept(rows)
    assert sorted((tuple(r) for r in jaccard.query(frame(spark, rows), ws).collect()), key=repr) == brute_links(rows)


def brute_quality(rows):
    """Texts that the quality rules keep, judged by the SQL of the query."""
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())}))
    found = con.execute(quality.SQL)
    at = {d[0]: i for i, d in enumerate(found.description)}
    kept = {r[at["doc_id"]] for r in found.fetchall() if r[at["kept"]]}
    return {i: t or "" for i, t in rows if i in kept}


def brute_lines(docs):
    """Texts without the lines that at least five documents share, but in the largest id holding them."""
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in docs.items():
        for k in {key(line) for line in t.split("\n")}:
            if len(k) >= 40:
                held.setdefault(k, []).append(i)
    goes = {k: max(ids) for k, ids in held.items() if len(ids) >= 5}
    return {i: "\n".join(line for line in t.split("\n") if goes.get(key(line), i) == i) for i, t in docs.items()}


def brute_pieces(docs, vocabulary):
    """(doc_id, piece) with start, length and checksum of the ids."""
    tokens, out = Tokenizer.from_file(vocabulary), {}
    for i, t in docs.items():
        ids = [*tokens.encode(t, add_special_tokens=False).ids, 0]
        for at in range(0, len(ids), 2048):
            piece = np.array(ids[at:at + 2048], "<u4")
            out[i, at // 2048] = (at, len(piece), zlib.crc32(piece.tobytes()))
    return out


def by_id(df):
    rows = df.select("doc_id", "text", "n_chars").collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: r.text or "" for r in rows}


def test_pipeline_stage_by_stage(spark):
    """Every stage against brute force on its own input, and the whole run against the last of them."""
    import corpus_pipeline
    from emberlog.llm.common import read

    data = os.environ.get("TESTDATA", "/root/testdata") + "/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    docs = read(spark, data, "documents")
    raw = [(r.doc_id, r.text) for r in docs.collect()]
    kept = corpus_pipeline.quality_rules(spark, docs, data)
    assert by_id(kept) == brute_quality(raw)
    thin = corpus_pipeline.line_dedup(spark, kept, data)
    texts = by_id(thin)
    assert texts == brute_lines(brute_quality(raw))
    near = corpus_pipeline.near_dedup(spark, thin, data)
    left = by_id(near)
    assert sorted(left.items(), key=repr) == brute_kept(list(texts.items()))
    rest = corpus_pipeline.substring_dedup(spark, near, data)
    cut = brute_repeats(list(left.items()))
    rows = rest.collect()
    assert len(rows) == len(left) and all(r.n_chars == len(r.text) for r in rows)
    for r in rows:
        assert hashlib.sha256(r.text.encode()).hexdigest() == cut[r.doc_id, left[r.doc_id]][3], r.doc_id
    packed = corpus_pipeline.run(spark, data).collect()
    want = brute_pieces({r.doc_id: r.text for r in rows}, WORD)
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in packed} == want and len(packed) == len(want)
    filled = {}
    for r in packed:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in filled.values():
        ends = np.cumsum([0] + [n for _, n in sorted(places)])
        assert [at for at, _ in sorted(places)] == ends[:-1].tolist() and ends[-1] <= 2048
    assert rest.columns == docs.columns and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_on_an_empty_table_and_on_hard_documents(spark, tmp_path):
    """Nulls, repeated rows, clashing names and control characters go through; no rows give no rows."""
    import corpus_pipeline

    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    # The rules reject all of these documents, so the stages behind them are given the documents themselves.
    docs = frame(spark, ROWS)
    assert corpus_pipeline.quality_rules(spark, docs, "").columns == docs.columns
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        kept = stage(spark, docs, "")
        assert kept.columns == docs.columns
        kept.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    last = [(r.doc_id, r.text or "") for r in docs.collect()]
    packed = corpus_pipeline.best_fit_packing(spark, docs, "").collect()
    want = sorted(((i, *piece) for i, t in last for (_, _), piece in brute_pieces({i: t}, WORD).items()), key=repr)
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32) for r in packed), key=repr) == want and len(last) > 20


@pytest.mark.parametrize("many", [2000, 20_000])
def test_packing_of_triples_that_fill_a_sequence(many):
    """Three pieces of a quarter to a half each fill a sequence without a gap: the optimum is known."""
    rng = np.random.default_rng(many)
    a, b = rng.integers(513, 1024, (2, 20 * many))
    c = 2048 - a - b
    good = np.flatnonzero((c > 512) & (c < 1024))[:many]
    demand = np.bincount(np.concatenate([a[good], b[good], c[good]]), minlength=2049)
    made = packing.configurations(demand)
    assert all(sum(config) <= 2048 for config, _ in made)
    assert (sum(np.bincount(config, minlength=2049) * n for config, n in made) == demand).all()
    assert sum(n for _, n in made) <= 1.01 * many
