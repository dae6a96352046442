"""Queries and oracles of cleaning, profiling and features."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import cleaning as cl, features as ft, quality as ql
from ..operators.indexing import index_rows
from ..plans.rulebook import CLEANING_PATTERNS, CONTENT_FLAGS, ERROR_LEVELS, PROBLEM_COMPONENTS, STOP_WORDS
from .base import logs, query, quoted, sql
from .detection import rounded
from .text import TEMPLATE

# A parsed table with levels, and some missing keys, contents and components.
LEVEL = "CASE WHEN event_type = 'error' AND k % 3 = 0 THEN 'ERROR' WHEN event_type = 'purchase' AND k % 10 = 0 THEN 'ALERT' WHEN k = 50 THEN NULL ELSE 'INFO' END"
COMPONENT = "CASE WHEN k = 51 THEN NULL WHEN k = 52 THEN 'SSHGuard-x' ELSE component END"
KEY = "CASE WHEN k = 13 THEN NULL ELSE {} END"
EVENT = "event_type"
LONG = "CASE WHEN k = 14 AND event_type = 'click' THEN rpad(content, 400, ' x') WHEN k = 15 AND event_type = 'view' THEN rpad(content, 120, ' x') ELSE content END"
PARSED = (f"parsed AS (SELECT line_id, k, value, stamp, left(stamp, 6) AS date, right(stamp, 8) AS time, pid, 'Jan' AS month, {LEVEL} AS level, {COMPONENT} AS component, "
          f"{LONG} AS content, {KEY.format(TEMPLATE)} AS event_template, {KEY.format(EVENT)} AS event_id FROM logs)")


def parsed(spark, sf):
    template = F.expr(KEY.format("regexp_replace(content, '[0-9]+', '<*>')"))
    return logs(spark, sf).select(
        "line_id", "k", "value", "stamp", F.expr("left(stamp, 6)").alias("date"), F.expr("right(stamp, 8)").alias("time"), "pid",
        F.lit("Jan").alias("month"), F.expr(LEVEL).alias("level"), F.expr(COMPONENT).alias("component"), F.expr(LONG).alias("content"),
        template.alias("event_template"), F.expr(KEY.format(EVENT)).alias("event_id"))


COLS = ["line_id", "level", "component", "content", "event_template", "event_id"]
C = ", ".join(COLS)
CTEXT = "lower(coalesce(content, '') || ' ' || coalesce(event_template, ''))"
NOT_LEVEL = "(level IS NULL OR level NOT IN (" + ", ".join(map(quoted, ERROR_LEVELS)) + "))"
PATTERNS = [(c, p) for c, ps in CLEANING_PATTERNS.items() for p in ps]
ANY_HIT = "(" + " OR ".join(f"regexp_matches({CTEXT}, {quoted(p)})" for _, p in PATTERNS) + ")"
ANY_COMP = "coalesce(" + " OR ".join(f"contains(lower(component), {quoted(c)})" for c in PROBLEM_COMPONENTS) + ", false)"
WORDS = "len(regexp_extract_all(content, '\\S+'))"
STAGED = (f"early AS MATERIALIZED (SELECT *, length(content) AS len, {WORDS} AS wc, CASE WHEN NOT {NOT_LEVEL} THEN 'level' WHEN {ANY_HIT} THEN 'content' WHEN {ANY_COMP} THEN 'component' END AS e FROM parsed), "
          "b1 AS (SELECT avg(len) - 3 * stddev_samp(len) AS lo, avg(len) + 3 * stddev_samp(len) AS hi FROM early WHERE e IS NULL), "
          "mid AS (SELECT early.*, CASE WHEN e IS NOT NULL THEN e WHEN len < lo OR len > hi THEN 'length' END AS m FROM early, b1), "
          "b2 AS (SELECT avg(wc) - 3 * stddev_samp(wc) AS lo, avg(wc) + 3 * stddev_samp(wc) AS hi FROM mid WHERE m IS NULL), "
          "staged AS MATERIALIZED (SELECT mid.*, CASE WHEN m IS NOT NULL THEN m WHEN wc < lo OR wc > hi THEN 'words' WHEN event_template IS NULL OR event_id IS NULL THEN 'keys' END AS dropped_at FROM mid, b2)")


@query("filter_error_levels", sql(f"SELECT {C} FROM parsed WHERE {NOT_LEVEL}", PARSED))
def filter_error_levels(spark, sf, ws):
    return cl.filter_error_levels(parsed(spark, sf)).select(*COLS)


@query("filter_anomalous_content", sql(f"SELECT {C} FROM parsed WHERE NOT {ANY_HIT}", PARSED))
def filter_anomalous_content(spark, sf, ws):
    return cl.filter_anomalous_content(parsed(spark, sf)).select(*COLS)


@query("filter_components", sql(f"SELECT {C} FROM parsed WHERE NOT {ANY_COMP}", PARSED))
def filter_components(spark, sf, ws):
    return cl.filter_components(parsed(spark, sf)).select(*COLS)


@query("drop_null_keys", sql(f"SELECT {C} FROM parsed WHERE event_template IS NOT NULL AND event_id IS NOT NULL", PARSED))
def drop_null_keys(spark, sf, ws):
    return cl.drop_null_keys(parsed(spark, sf)).select(*COLS)


@query("sigma_outliers", sql(f"SELECT {C} FROM (SELECT x.* FROM x, (SELECT avg(wc) AS a, stddev_samp(wc) AS s FROM x) t WHERE wc BETWEEN a - 3 * s AND a + 3 * s) y",
                             PARSED, f"x AS (SELECT p.*, {WORDS} AS wc FROM parsed p, (SELECT avg(length(content)) AS a, stddev_samp(length(content)) AS s FROM parsed) t "
                             "WHERE length(content) BETWEEN a - 3 * s AND a + 3 * s)"))
def sigma_outliers(spark, sf, ws):
    return cl.drop_outliers(ws.stage(parsed(spark, sf), "parsed")).select(*COLS)


@query("clean_training_data", sql(f"SELECT {C} FROM staged WHERE dropped_at IS NULL", PARSED, STAGED))
def clean_training_data(spark, sf, ws):
    return cl.clean_training_data(parsed(spark, sf), ws).select(*COLS)


@query("cleaning_funnel", sql("SELECT position, stage, total - gone AS \"left\", gone AS removed, round(100.0::DOUBLE * gone / total, 6) AS removed_pct FROM "
                              "(SELECT position, stage, (SELECT count(*) FROM staged) AS total, CAST(sum(n) OVER (ORDER BY position) AS BIGINT) AS gone FROM (SELECT d.position, d.stage, count(s.line_id) AS n FROM "
                              "(SELECT unnest(range(6)) AS position, unnest(['level', 'content', 'component', 'length', 'words', 'keys']) AS stage) d LEFT JOIN staged s ON s.dropped_at = d.stage GROUP BY ALL) a) b", PARSED, STAGED))
def cleaning_funnel(spark, sf, ws):
    return rounded(cl.cleaning_funnel(cl.with_stage(parsed(spark, sf), ws)), "removed_pct")


@query("pattern_hit_counts", sql(" UNION ALL ".join(f"SELECT {quoted(c)} AS category, {quoted(p)} AS pattern, count(CASE WHEN regexp_matches({CTEXT}, {quoted(p)}) THEN 1 END) AS hits FROM parsed WHERE {NOT_LEVEL}"
                                                   for c, p in PATTERNS), PARSED))
def pattern_hit_counts(spark, sf, ws):
    return cl.pattern_hits(parsed(spark, sf))


@query("removed_rows", sql("SELECT line_id, content FROM staged WHERE dropped_at IS NOT NULL", PARSED, STAGED))
def removed_rows(spark, sf, ws):
    rows = parsed(spark, sf)
    return cl.removed_rows(rows, cl.clean_training_data(rows, ws)).select("line_id", "content")


@query("removed_profile", sql("SELECT 'level' AS kind, level AS name, count(*) AS n FROM staged WHERE dropped_at IS NOT NULL GROUP BY ALL UNION ALL "
                              "(SELECT 'component', component, count(*) AS n FROM staged WHERE dropped_at IS NOT NULL GROUP BY ALL ORDER BY n DESC, component NULLS FIRST LIMIT 10) UNION ALL "
                              "SELECT 'sample', substr(content, 1, 80), 1 FROM (SELECT * FROM staged WHERE dropped_at IS NOT NULL ORDER BY line_id LIMIT 5) t", PARSED, STAGED))
def removed_profile(spark, sf, ws):
    staged = cl.with_stage(parsed(spark, sf), ws)
    return cl.removed_profile(staged.filter("dropped_at is not null"))


@query("validate_columns", sql("SELECT count(*) AS total_entries, true AS valid, '' AS missing_required, 'content,level,component,date,time' AS available_recommended, "
                               "'line_id,month' AS available_beneficial, true AS ready FROM parsed", PARSED))
def validate_columns(spark, sf, ws):
    return ql.validate_columns(parsed(spark, sf))


@query("quality_issues", sql("SELECT total, empty_templates, unique_events, empty_content, array_to_string(list_filter([CASE WHEN empty_templates > 0 THEN 'empty templates' END, "
                             "CASE WHEN unique_events < total * 0.1 THEN 'low template diversity' END, CASE WHEN empty_content > total * 0.5 THEN 'high empty content ratio' END], lambda x: x IS NOT NULL), '|') AS issues FROM "
                             "(SELECT count(*) AS total, count(CASE WHEN event_template IS NULL THEN 1 END) AS empty_templates, count(DISTINCT event_id) AS unique_events, "
                             "count(CASE WHEN content IS NULL THEN 1 END) AS empty_content FROM parsed) t", PARSED))
def quality_issues(spark, sf, ws):
    return ql.quality_issues(parsed(spark, sf)).withColumn("issues", F.array_join("issues", "|"))


@query("parsing_stats", sql("SELECT count(*) AS total_logs, count(DISTINCT event_template) AS unique_templates, count(DISTINCT component) AS unique_components, min(date) AS first_date, max(date) AS last_date, "
                            "round(avg(length(content)), 6) AS avg_length, CAST(max(length(content)) AS BIGINT) AS max_length, (SELECT string_agg(level || '=' || n, ',' ORDER BY level) FROM (SELECT level, CAST(count(*) AS STRING) AS n "
                            "FROM parsed WHERE level IS NOT NULL GROUP BY ALL) l) AS log_levels FROM parsed", PARSED))
def parsing_stats(spark, sf, ws):
    stats = ql.parsing_stats(parsed(spark, sf))
    shown = F.array_join(F.sort_array(F.transform(F.map_entries("log_levels"),
                                                  lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",")
    return rounded(stats.withColumn("log_levels", shown), "avg_length")


@query("feature_prevalence", sql(" UNION ALL ".join(f"SELECT {quoted(n)} AS feature, round(avg(CASE WHEN regexp_matches(content, {quoted(p)}, 'i') THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS pct FROM parsed"
                                                   for n, p in CONTENT_FLAGS.items()), PARSED))
def feature_prevalence(spark, sf, ws):
    return rounded(ql.feature_prevalence(parsed(spark, sf)), "pct")


@query("select_model_columns", sql("SELECT level, component, content, event_template, event_id FROM parsed", PARSED))
def select_model_columns(spark, sf, ws):
    return ft.drop_temporal(parsed(spark, sf)).select("level", "component", "content", "event_template", "event_id")


@query("cardinality_gate", sql("SELECT count(DISTINCT event_template) AS distinct_values, count(DISTINCT event_template) < 1000 AS keep FROM parsed", PARSED))
def cardinality_gate(spark, sf, ws):
    return ql.cardinality_gate(parsed(spark, sf), "event_template")


# ---- features -----------------------------------------------------------------------------------

STOP = "[" + ", ".join(map(quoted, STOP_WORDS)) + "]"
TFIDF = (f"kept AS (SELECT line_id, list_filter(regexp_extract_all(lower({TEMPLATE}), '\\b[a-zA-Z]{{3,}}\\b'), lambda w: NOT list_contains({STOP}, w)) AS ws FROM logs), "
         "grams AS (SELECT line_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM kept), "
         "tfs AS MATERIALIZED (SELECT line_id, term, count(*) AS n FROM grams GROUP BY ALL), "
         "vocab AS MATERIALIZED (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM logs)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM tfs GROUP BY term "
         "HAVING count(*) >= 3 AND count(*) <= 0.7 * (SELECT count(*) FROM logs) ORDER BY sum(n) DESC, term LIMIT 50), "
         "raw AS (SELECT line_id, term, n * idf AS w FROM tfs JOIN vocab USING (term))")


@query("tfidf_templates", sql("SELECT line_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY line_id)), 6) AS weight FROM raw", TFIDF))
def tfidf_templates(spark, sf, ws):
    rows = logs(spark, sf).select("line_id", F.regexp_replace("content", "[0-9]+", "<*>").alias("event_template"))
    model = ft.Tfidf.fit(rows)
    named = F.arrays_zip(F.array(*[F.lit(t) for t in model.terms]).alias("term"), F.col("tfidf").alias("weight"))
    return rounded(model.transform(rows, ws).select("line_id", F.inline(named)).toDF("line_id", "term", "weight").filter("weight > 0"), "weight")


def _top(col):
    return (f"SELECT {quoted(col)} AS feature, c, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, c DESC) AS rk, count(*) OVER () AS cats "
            f"FROM (SELECT CAST({col} AS STRING) AS c FROM logs) GROUP BY c")


HOT = ["component", "host", "pid"]


@query("one_hot", sql(f"SELECT feature, CASE WHEN cats > 50 AND rk > 49 THEN 'infrequent' ELSE c END AS category, CAST(sum(n) AS BIGINT) AS n FROM ({' UNION ALL '.join(_top(c) for c in HOT)}) t GROUP BY ALL"))
def one_hot(spark, sf, ws):
    """Column sums of the one-hot arrays, per category."""
    rows, out = ws.stage(logs(spark, sf).select(*HOT), "categories"), None
    for column in HOT:
        kept, rest = ft.fit_categories(rows, column)
        names = F.array(*[F.lit(n) for n in ([*kept, ft.INFREQUENT] if rest else kept)])
        sums = (rows.select(F.posexplode(ft.one_hot(F.col(column), kept, rest)).alias("at", "flag"))
                .groupBy("at").agg(F.sum("flag").cast("long").alias("n"))
                .select(F.lit(column).alias("feature"), F.get(names, F.col("at")).alias("category"), "n"))
        out = sums if out is None else out.unionByName(sums)
    return out


@query("label_encode", sql("SELECT line_id, dense_rank() OVER (ORDER BY component) - 1 AS component_code, dense_rank() OVER (ORDER BY host) - 1 AS host_code FROM logs"))
def label_encode(spark, sf, ws):
    rows = logs(spark, sf).select("line_id", "component", "host")
    coded = ft.label_encode(ft.label_encode(rows, "component", ws), "host", ws)
    return coded.select("line_id", "component_code", "host_code")


GAPS = "nums AS (SELECT line_id, CASE WHEN k % 11 = 0 THEN NULL ELSE value END AS value, CAST(length(content) AS DOUBLE) AS size, 1.0::DOUBLE AS same FROM logs)"


def numbers(spark, sf, ws):
    return ws.stage(logs(spark, sf).select("line_id", F.expr("CASE WHEN k % 11 = 0 THEN NULL ELSE value END").alias("value"),
                                           F.length("content").cast("double").alias("size"), F.lit(1.0).alias("same")), "numbers")


@query("impute_mean", sql("SELECT line_id, round(coalesce(value, (SELECT avg(value) FROM nums)), 6) AS value FROM nums", GAPS))
def impute_mean(spark, sf, ws):
    return rounded(ft.impute_mean(numbers(spark, sf, ws), ["value"]).select("line_id", "value"), "value")


@query("standard_scale", sql("SELECT line_id, round((size - (SELECT avg(size) FROM nums)) / (SELECT stddev_pop(size) FROM nums), 6) AS size, 0.0::DOUBLE AS same FROM nums", GAPS))
def standard_scale(spark, sf, ws):
    return rounded(ft.standard_scale(numbers(spark, sf, ws), ["size", "same"]).select("line_id", "size", "same"), "size")


@query("assemble", sql("SELECT line_id, CAST(length(content) AS STRING) || '|' || " + " || '|' || ".join(
    f"CAST(CAST(regexp_matches(content, {quoted(p)}, 'i') AS INT) AS STRING)" for p in CONTENT_FLAGS.values()) + " AS features FROM logs"))
def assemble(spark, sf, ws):
    rows = ft.assemble(ft.content_features(logs(spark, sf)), ["content_length", *CONTENT_FLAGS])
    return rows.select("line_id", F.array_join(vector_to_array("features").cast("array<int>").cast("array<string>"), "|").alias("features"))


@query("chrono_split", sql("SELECT line_id, CASE WHEN idx < CAST(floor(0.7 * n) AS BIGINT) THEN 'train' WHEN idx < CAST(floor(0.7 * n) AS BIGINT) + CAST(floor(0.15 * n) AS BIGINT) THEN 'validation' ELSE 'test' END AS split "
                           "FROM (SELECT line_id, row_number() OVER (ORDER BY line_id) - 1 AS idx, (SELECT count(*) FROM logs) AS n FROM logs) t"))
def chrono_split(spark, sf, ws):
    rows = index_rows(logs(spark, sf).select("line_id"), ["line_id"], ws)
    return ft.chrono_split(rows, rows.count()).select("line_id", "split")


@query("fit_save_apply")
def fit_save_apply(spark, sf, ws):
    """Fit on the first part of the logs, save, load, and apply to all of them."""
    rows = logs(spark, sf).select("line_id", F.col("host").alias("level"), "component", "content",
                                  F.regexp_replace("content", "[0-9]+", "<*>").alias("event_template"), F.col("event_type").alias("event_id"))
    rows = index_rows(rows, ["line_id"], ws)
    train = ft.chrono_split(rows, rows.count()).filter("split = 'train'")
    path = ws.path("preprocessor")
    ft.Preprocessor.fit(train, ws).save(spark, path)
    return ft.Preprocessor.load(spark, path).transform(rows, ws).select(
        "line_id", F.array_join(F.transform(vector_to_array("features"), lambda x: F.round(x, 4)).cast("array<string>"), "|").alias("features"))


@query("write_clean", sql("SELECT line_id, content, (SELECT count(*) FROM staged) AS original, (SELECT count(*) FROM staged WHERE dropped_at IS NULL) AS clean, "
                          "(SELECT count(dropped_at) FROM staged) AS removed, (SELECT round(100.0::DOUBLE * count(dropped_at) / count(*), 1) FROM staged) AS removed_pct, "
                          "true AS aggressive FROM staged WHERE dropped_at IS NULL", PARSED, STAGED))
def write_clean(spark, sf, ws):
    """Both outputs read back: the cleaned rows, and the report's figures beside them."""
    from ..sources.sinks import write_clean as write
    path = ws.path("clean")
    write(parsed(spark, sf), path, ws)
    figures = spark.read.parquet(f"{path}/report").first().asDict()
    return spark.read.parquet(f"{path}/data").select("line_id", "content", *[F.lit(v).alias(k) for k, v in figures.items()])
