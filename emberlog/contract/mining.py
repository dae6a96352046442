"""Queries and oracles of template mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import is_parameter
from ..operators import templates as tm
from ..plans.presets import PRESETS, Preset
from .base import logs, query, quoted, sql

LINUX = PRESETS["Linux"]


def norm_sql(preset: Preset, col: str = "content") -> str:
    for pattern in preset.masks:
        col = f"regexp_replace({col}, {quoted(pattern)}, '<*>', 'g')"
    for pattern in preset.deletions:
        col = f"regexp_replace({col}, {quoted(pattern)}, '', 'g')"
    for mark in preset.separators:
        col = f"replace({col}, {quoted(mark)}, {quoted(mark + ' ')})"
    return f"regexp_replace(replace({col}, ',', ', '), ' +', ' ', 'g')"


PARAM_SQL = ("(contains(word, '<*>') OR (length(regexp_replace(word, '[^0-9]', '', 'g')) > 0 AND "
             "length(regexp_replace(word, '[^0-9]', '', 'g'))::DOUBLE / length(word) >= CAST(0.3 AS DOUBLE)))")

SPLIT = f"sp AS (SELECT line_id, string_split({norm_sql(LINUX)}, ' ') AS ws FROM logs)"
TOK = ("tok AS (SELECT line_id, len(ws) AS n_tokens, unnest(range(len(ws))) AS pos, unnest(ws) AS word FROM sp)")
FREQ = "fr AS (SELECT pos, word, count(*) AS freq FROM tok GROUP BY ALL)"
TF = "tf AS MATERIALIZED (SELECT t.*, f.freq FROM tok t JOIN fr f USING (pos, word))"
COMBO = "combo AS (SELECT line_id, n_tokens, freq, count(*) AS n, min(pos) AS mp FROM tf GROUP BY ALL)"
ROOT = ("root AS MATERIALIZED (SELECT line_id, n_tokens, freq AS root_freq, n AS root_count FROM "
        "(SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY n DESC, mp) AS rn FROM combo) WHERE rn = 1)")
GROUPS = ("grp AS MATERIALIZED (SELECT n_tokens, root_freq, root_count, min(line_id) AS first_line, count(*) AS n_lines "
          "FROM root GROUP BY ALL)")
CAND = ("cand AS (SELECT g.n_tokens, g.root_freq, g.root_count, t.pos FROM grp g JOIN tf t ON t.line_id = g.first_line "
        "WHERE t.freq <> g.root_freq)")
GTOK = ("gtok AS MATERIALIZED (SELECT t.line_id, t.pos, t.word, t.freq, r.n_tokens, r.root_freq, r.root_count "
        "FROM tf t JOIN root r USING (line_id))")
VPOS = ("vpos AS MATERIALIZED (SELECT n_tokens, root_freq, root_count, pos FROM gtok JOIN cand USING "
        f"(n_tokens, root_freq, root_count, pos) GROUP BY ALL HAVING count(DISTINCT word) >= {LINUX.threshold})")
VARS = ("vars AS MATERIALIZED (SELECT DISTINCT n_tokens, root_freq, root_count, word FROM gtok JOIN vpos USING "
        "(n_tokens, root_freq, root_count, pos))")
TPL = (f"tpl AS MATERIALIZED (SELECT line_id, n_tokens, root_freq, root_count, string_agg(CASE WHEN v.word IS NOT NULL OR {PARAM_SQL.replace('word', 'g.word')} "
       "THEN '<*>' ELSE g.word END, ' ' ORDER BY pos) AS event_template FROM gtok g LEFT JOIN vars v USING "
       "(n_tokens, root_freq, root_count, word) GROUP BY ALL)")
ORDERED = ("ordered AS (SELECT event_template, min({'l': lf, 'g': gf, 'f': line_id}) AS pos_first, count(*) AS occurrences FROM "
           "(SELECT t.*, min(line_id) OVER (PARTITION BY n_tokens) AS lf, "
           "min(line_id) OVER (PARTITION BY n_tokens, root_freq, root_count) AS gf FROM tpl t) GROUP BY event_template)")
EVENTS = ("ev AS (SELECT 'E' || CAST(row_number() OVER (ORDER BY pos_first) - 1 AS STRING) AS event_id, event_template, "
          "occurrences FROM ordered)")
CHAIN = [SPLIT, TOK, FREQ, TF, COMBO, ROOT, GROUPS, CAND, GTOK, VPOS, VARS, TPL, ORDERED, EVENTS]


def upto(last: str) -> list[str]:
    return CHAIN[: CHAIN.index(last) + 1]


@query("token_positions", sql("SELECT line_id, CAST(pos AS BIGINT) AS pos, word FROM tok", SPLIT, TOK))
def token_positions(spark, sf, ws):
    return tm.explode_tokens(logs(spark, sf), LINUX).withColumn("pos", F.col("pos").cast("long"))


@query("positional_token_freq", sql("SELECT CAST(pos AS BIGINT) AS pos, word, freq FROM fr", SPLIT, TOK, FREQ))
def positional_token_freq(spark, sf, ws):
    shapes = tm.line_shapes(logs(spark, sf), LINUX, ws)
    return tm.positional_token_freq(shapes).select(F.col("pos").cast("long"), "word", "freq")


@query("length_groups", sql("SELECT CAST(len(ws) AS BIGINT) AS n_tokens, count(*) AS n_lines FROM sp GROUP BY ALL", SPLIT))
def length_groups(spark, sf, ws):
    return tm.length_groups(logs(spark, sf), LINUX).withColumn("n_tokens", F.col("n_tokens").cast("long"))


@query("join_token_freq", sql("SELECT CAST(pos AS BIGINT) AS pos, word, freq, count(*) AS n FROM tf GROUP BY ALL", *upto(TF)))
def join_token_freq(spark, sf, ws):
    """Every word occurrence with its frequency, counted per (position, word, frequency)."""
    tokens = tm.join_token_freq(tm.line_shapes(logs(spark, sf), LINUX, ws), ws)
    return (tokens.groupBy(F.col("pos").cast("long").alias("pos"), "word", "freq").agg(F.sum("n").alias("n")))


def annotated(spark, sf, ws):
    return tm.annotated_shapes(tm.line_shapes(logs(spark, sf), LINUX, ws), ws)


def with_lines(spark, sf, ws, shapes, *columns):
    """Rows per shape back to rows per line."""
    lines = logs(spark, sf).select("line_id", tm.normalized(F.col("content"), LINUX).alias("norm"))
    named = tm.line_shapes(logs(spark, sf), LINUX, ws).select("norm", "sid")
    return lines.join(named, "norm").join(shapes, "sid").select("line_id", *columns)


@query("frequency_combinations", sql("SELECT line_id, freq, n AS n_words FROM combo", *upto(COMBO)))
def frequency_combinations(spark, sf, ws):
    combos = tm.frequency_combinations(annotated(spark, sf, ws))
    return with_lines(spark, sf, ws, combos, "freq", F.col("n_words").cast("long"))


@query("root_pattern", sql("SELECT line_id, CAST(n_tokens AS BIGINT) AS n_tokens, root_freq, root_count FROM root", *upto(ROOT)))
def root_pattern(spark, sf, ws):
    return with_lines(spark, sf, ws, annotated(spark, sf, ws), F.col("n_tokens").cast("long"), "root_freq",
                      F.col("root_count").cast("long"))


@query("root_groups", sql("SELECT CAST(n_tokens AS BIGINT) AS n_tokens, root_freq, root_count, first_line, n_lines FROM grp",
                          *upto(GROUPS)))
def root_groups(spark, sf, ws):
    return (tm.root_groups(annotated(spark, sf, ws)).drop("rows")
            .withColumn("n_tokens", F.col("n_tokens").cast("long")).withColumn("root_count", F.col("root_count").cast("long")))


@query("child_variables", sql("SELECT CAST(n_tokens AS BIGINT) AS n_tokens, root_freq, root_count, CAST(pos AS BIGINT) AS pos "
                              "FROM vpos", *upto(VPOS)))
def child_variables(spark, sf, ws):
    groups = tm.variable_groups(annotated(spark, sf, ws), LINUX.threshold, ws)
    return groups.select(F.col("n_tokens").cast("long"), "root_freq", F.col("root_count").cast("long"),
                         F.explode(F.col("variable").cast("array<long>")).alias("pos"))


@query("variable_words", sql("SELECT CAST(pos AS BIGINT) AS pos, word, count(*) AS n FROM gtok g SEMI JOIN vars v USING "
                             "(n_tokens, root_freq, root_count, word) GROUP BY ALL", *upto(VARS)))
def variable_words(spark, sf, ws):
    shapes = annotated(spark, sf, ws)
    groups = tm.variable_groups(shapes, LINUX.threshold, ws)
    return (tm.variable_words(shapes, groups, ws)
            .groupBy(F.col("pos").cast("long").alias("pos"), "word").agg(F.sum("n").alias("n")))


@query("digit_ratio_mask", sql(f"SELECT word, CASE WHEN {PARAM_SQL} THEN '<*>' ELSE word END AS masked, count(*) AS n "
                               "FROM tok GROUP BY ALL", SPLIT, TOK))
def digit_ratio_mask(spark, sf, ws):
    tokens = tm.explode_tokens(logs(spark, sf), LINUX).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return tokens.select("word", F.when(is_parameter(F.col("word")), "<*>").otherwise(F.col("word")).alias("masked"), "n")


@query("assemble_templates", sql("SELECT line_id, event_template FROM tpl", *upto(TPL)))
def assemble_templates(spark, sf, ws):
    lines = logs(spark, sf)
    return tm.mine(lines, LINUX, ws, hashed_ids=True).events(lines).select("line_id", "event_template")


@query("template_catalogue", sql("SELECT event_template, count(*) AS occurrences FROM tpl GROUP BY ALL", *upto(TPL)))
def template_catalogue(spark, sf, ws):
    _, catalogue = tm.shape_templates(logs(spark, sf), LINUX, ws)
    return tm.hashed_event_ids(catalogue).select("event_template", "occurrences")


@query("event_ids", sql("SELECT event_id, event_template, occurrences FROM ev", *CHAIN))
def event_ids(spark, sf, ws):
    _, catalogue = tm.shape_templates(logs(spark, sf), LINUX, ws)
    return tm.assign_event_ids(catalogue, ws)


@query("mine_templates", sql("SELECT line_id, event_id, event_template FROM tpl JOIN ev USING (event_template)", *CHAIN))
def mine_templates(spark, sf, ws):
    lines = logs(spark, sf)
    return tm.mine(lines, LINUX, ws).events(lines).select("line_id", "event_id", "event_template")


ACCURACY = """
, cells AS (SELECT l.branch, t.event_template, count(*)::DOUBLE AS n FROM logs l JOIN tpl t USING (line_id) GROUP BY ALL),
 sums AS (SELECT *, sum(n) OVER (PARTITION BY branch) AS nt, sum(n) OVER (PARTITION BY event_template) AS np FROM cells),
 tot AS (SELECT (SELECT sum(n*(n-1)/2) FROM cells) AS hits,
  (SELECT sum(s*(s-1)/2) FROM (SELECT sum(n) AS s FROM cells GROUP BY branch)) AS tp,
  (SELECT sum(s*(s-1)/2) FROM (SELECT sum(n) AS s FROM cells GROUP BY event_template)) AS pp,
  (SELECT sum(CASE WHEN n = nt AND n = np THEN n ELSE 0 END) / sum(n) FROM sums) AS accuracy)
SELECT round(hits/pp, 6) AS precision, round(hits/tp, 6) AS recall,
 round(2*(hits/pp)*(hits/tp)/((hits/pp)+(hits/tp)), 6) AS f1, round(accuracy, 6) AS accuracy FROM tot
"""


@query("parse_accuracy", sql(ACCURACY, *upto(TPL)))
def parse_accuracy(spark, sf, ws):
    lines = logs(spark, sf)
    parsed = tm.mine(lines, LINUX, ws, hashed_ids=True).events(lines)
    truth = lines.select("line_id", F.col("branch").alias("event_id"))
    scores = tm.parse_accuracy(truth, parsed.select("line_id", "event_id"))
    return scores.select(*[F.round(c, 6).alias(c) for c in scores.columns])
