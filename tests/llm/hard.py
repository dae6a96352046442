"""Documents made to be hard for the operators."""

import random

# Columns that the operators use inside, as extra columns of the input.
CLASHING = ["quality", "_counts", "line_dedup", "substring_dedup", "doc", "body", "range", "again", "key", "node", "set",
            "spans", "_spans", "_doc", "_body", "_held", "_keep", "pos", "h1", "sig", "score", "length", "rank"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{'abcde'[rng.randrange(5)]}" for _ in range(n))


def twins(one="a", other="b", doublings=10):
    """Two texts that collide under every polynomial hash modulo 2**64 with an odd base: a Thue-Morse
    word of 1,024 letters and its complement."""
    a, b = one, other
    for _ in range(doublings):
        a, b = a + b, b + a
    return a, b


def hard_documents():
    """Copies, near copies, shared passages and lines, nulls, empty and very long texts, repeated rows."""
    rng = random.Random(5)
    base = prose(rng, 120)
    passage = prose(rng, 60)
    line = "The same line of a licence that many documents have in common"
    texts = [base, base, base.replace("w1", "v1", 1), base + " tail", None, "", "  \n\t\n", "one two", "one  two\n",
             "x" * 300, "ab" * 400, "y " * 200, "é" * 150 + "日本語🙂" * 30, "<|im_end|> & &amp; <|endoftext|>",
             prose(rng, 4000, 5000), "\n".join([line] * 3), "a\n" + line.upper() + "  \nb", "\n\n" + line + "\n"]
    texts += [prose(rng, rng.randrange(1, 90)) + "\n" + passage + " " + prose(rng, rng.randrange(1, 30)) for _ in range(12)]
    texts += [prose(rng, 30) + "\n  " + line + "\t\n" + prose(rng, 5) for _ in range(8)]
    words = base.split()
    for i in range(14):
        near = list(words)
        near[i * 7] = f"new{i}"
        texts.append(" ".join(near))
    texts += [*twins(), *twins("q", "Z"), *twins("x y ", "y x "), "cr\rvt\x0bff\x0c" + " ".join(f"a{i}\rb\x0bc\x0cd{i}" for i in range(40)), "kelvin \u212a \u0130stanbul \xb5 a\u0301 \x00\x00 \x00"]
    rows = [(i * 3 % 191, t) for i, t in enumerate(texts)]
    rows += [rows[0], rows[3], (rows[20][0], rows[20][1]), (None, "no id here"), (None, base)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src", len(t or ""), *[f"{c}-{i}" for c in CLASHING]) for i, t in rows],
                                 SCHEMA).repartition(3)
