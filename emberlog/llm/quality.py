"""Quality rules: a table of thresholds compiled into one projection.

All counts of a text come from built-in expressions over its words and lines in one pass over
the table, without a shuffle and without user functions, so a text of any length stays in its
row and no row waits for another.

Defined cases: a null text counts as the empty text; an empty text has no word, fails the base
rules and is not kept; repeated rows get the same verdict each; a text shorter than a window of
three words has no repeated words. Other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACES, bound, free_name, let, trimmed, words

SYMBOLS = "#*$%&|<>"
# Frequent function words of the four languages of the corpus (fixed values).
STOP_WORDS = (
    "the of and to in is that for it with as was by are be from this on or an a",
    "der die und das den ist von mit zu auf im ein eine nicht sich des dem als für auch",
    "le la les de des et un une est que en dans du pour qui ce il au pas sur",
    "el los las y que en del por con para una se no es su al lo como más o",
)
# The rules every contract user gets; the table below comes on top.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low <= part / whole <= high``; an open bound is None."""

    name: str
    part: str
    whole: str
    low: float | None = None
    high: float | None = None

    def passes(self) -> str:
        """The rule as SQL over the counts; cross-multiplied, so nothing is divided by zero."""
        sides = [f"{self.part} >= {self.low} * {self.whole}"] if self.low is not None else []
        sides += [f"{self.part} <= {self.high} * {self.whole}"] if self.high is not None else []
        return " AND ".join(sides)


RULES = (
    Rule("word_length", "word_chars", "n_words", 1.5, 20),
    Rule("symbols", "n_symbols", "n_words", None, 0.2),
    Rule("stop_words", "n_stop_words", "1", 2, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.5),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")


def _repeat_words(w: Column) -> Column:
    """Words that lie in a window of three words found twice or more in the same text.

    Windows are compared as 64-bit hashes within one text. Only a text that repeats a window is
    sorted to find where.
    """

    def repeated(g: Column) -> Column:
        placed = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(placed, covered))

    def covered(s: Column) -> Column:
        same = lambda e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
        hits = F.filter(s, lambda e, j: ((j > 0) & same(e, F.greatest(j - 1, F.lit(0)))) | same(e, j + 1))
        spread = F.transform(hits, lambda e: F.array(e["at"], e["at"] + 1, e["at"] + 2))
        return F.size(F.array_distinct(F.flatten(spread)))

    last = F.size(w) - 3
    grams = F.transform(F.sequence(F.lit(0), last),
                        lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(last < 0, F.lit(0)).otherwise(let(grams, repeated))


def _stop_words(w: Column) -> Column:
    """How many different stop words occur."""
    listed = sorted({s for row in STOP_WORDS for s in row.split()})
    return F.size(F.array_intersect(F.transform(w, F.lower), F.array(*map(F.lit, listed))))


def _counts(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(trimmed(line)) > 0)

    def of(w: Column, rows: Column) -> Column:
        values = (F.size(w), F.length(F.translate(text, SPACES, "")),
                  F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
                  F.size(rows) - F.size(F.array_distinct(rows)), _repeat_words(w), F.size(rows), _stop_words(w))
        return F.struct(*[v.cast("long").alias(n) for n, v in zip(COUNTS, values, strict=True)])

    return let(words(text), lambda w: let(lines, lambda rows: of(w, rows)))


def judge(docs: DataFrame, name: str = "quality", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add one struct column: all counts, ``base_failed``, the names of failed rules, ``kept``."""
    counts = free_name(docs, "_counts")
    measured = bound(docs, _counts(F.coalesce(F.col("text"), F.lit(""))), counts)
    value = {c: F.col(f"{counts}.{c}") for c in COUNTS}
    base = (value["n_words"] < MIN_WORDS) | (100 * value["n_repeat_words"] > MAX_REPEAT_PERCENT * value["n_words"])

    def compiled(rule: Rule) -> Column:
        number = lambda key: value[key] if key in value else F.lit(float(key))
        low = F.lit(True) if rule.low is None else number(rule.part) >= F.lit(float(rule.low)) * number(rule.whole)
        high = F.lit(True) if rule.high is None else number(rule.part) <= F.lit(float(rule.high)) * number(rule.whole)
        return low & high

    failed = F.array_compact(F.array(*[F.when(~compiled(r), F.lit(r.name)) for r in rules]))
    verdict = F.struct(*value.values(), base.alias("base_failed"), failed.alias("failed"),
                       (~base & (F.size(failed) == 0)).alias("kept"))
    return measured.withColumn(name, verdict).drop(counts)


def query(docs: DataFrame) -> DataFrame:
    """One row per document: the counts and verdicts."""
    judged = judge(docs.select("doc_id", "text"))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in (*base, "n_stop_words", "base_failed", "kept")])


def stage(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their columns as they are."""
    name = free_name(docs, "quality")
    return judge(docs, name).filter(F.col(f"{name}.kept")).drop(name)


def _sql() -> str:
    """The same result for DuckDB, from whole tables."""
    listed = ", ".join("'" + s + "'" for s in sorted({s for row in STOP_WORDS for s in row.split()}))
    checks = " AND ".join(f"({r.passes()})" for r in RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d),
p AS (SELECT rid, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM s),
g AS (SELECT rid, i, a, lead(a) OVER (PARTITION BY rid ORDER BY i) AS b, lead(a, 2) OVER (PARTITION BY rid ORDER BY i) AS c FROM p),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM g WHERE c IS NOT NULL) WHERE n > 1),
e AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS v(k) GROUP BY rid),
m AS (SELECT s.doc_id, len(w) AS n_words,
  coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(e.n, 0) AS n_repeat_words, len(l) AS n_lines,
  len(list_intersect(list_transform(w, lambda x: lower(x)), [{listed}])) AS n_stop_words
  FROM s LEFT JOIN e USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
 CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
 CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(n_stop_words AS BIGINT) AS n_stop_words, base_failed,
 NOT base_failed AND {checks} AS kept FROM b"""


SQL = _sql()
