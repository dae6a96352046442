"""Queries and oracles of sources, sinks, scorers and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import detect as dt, scoring as sc, templates as tm
from ..operators.classify import with_log_type
from ..operators.indexing import index_rows, percentiles
from ..operators.parsing import parse_preset
from ..sources import payloads as pl, sinks, streams, text as src
from ..streaming import jobs
from ..streaming.count_windows import state_count_windows, stream_count_windows
from .base import LOGS_SQL, LINE_SQL, logs, query, sql, table
from .detection import FULL, LOG, RECORD, anomalies, rounded, run, stored
from .mining import CHAIN, LINUX
from .text import COLLECT, LABELED_CTE, OUTPUT, PAYLOAD, VERDICT_CTE, payloads


# ---- sources ------------------------------------------------------------------------------------

def text_folder(spark, sf, ws, name="raw"):
    """The view's lines written as text, in several files whose names follow the line order."""
    folder = ws.path(name)
    lines = logs(spark, sf).select("line_id", "line")
    lines.repartitionByRange(4, "line_id").sortWithinPartitions("line_id").select("line").write.text(folder)
    return folder


@query("read_log_text", sql("SELECT row_number() OVER (ORDER BY line_id) AS number, line AS value FROM logs"))
def read_log_text(spark, sf, ws):
    rows = src.read_logs(spark, text_folder(spark, sf, ws))
    return src.number_lines(rows, ws, "number").select("number", "value")


@query("combine_rotated_logs", sql("SELECT line AS value, count(*) AS n FROM logs GROUP BY ALL"))
def combine_rotated_logs(spark, sf, ws):
    """Every line, written as plain, gz and bz2 files, one per task and codec, is read once."""
    folder, rows = ws.path("rotated"), logs(spark, sf).select("k", "line")
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for i, (suffix, codec) in enumerate([("", "none"), (".gz", "gzip"), (".bz2", "bzip2")]):
        part = ws.path("part")
        rows.filter(F.col("k") % 3 == i).select("line").write.option("compression", codec).text(part)
        found = jvm.org.apache.hadoop.fs.Path(f"{part}/part-*")
        fs = found.getFileSystem(conf)
        fs.mkdirs(jvm.org.apache.hadoop.fs.Path(folder))
        for number, file in enumerate(fs.globStatus(found)):
            fs.rename(file.getPath(), jvm.org.apache.hadoop.fs.Path(f"{folder}/messages.{i}{number:06}{suffix}"))
    return src.read_rotated(spark, folder).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("combine_hosts", sql("SELECT h, row_number() OVER (ORDER BY h, line_id) AS number, line AS value FROM (SELECT 'h' || CAST(1 + k % 2 AS STRING) AS h, line_id, line FROM logs) l"))
def combine_hosts(spark, sf, ws):
    """Two hosts' files have equal base names; all lines are numbered, one host after the other."""
    folder, rows = ws.path("hosts"), logs(spark, sf).select("k", "line_id", "line")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for host in (1, 2):
        home = f"{folder}/h{host}"
        part = rows.filter(F.col("k") % 2 == host - 1).repartitionByRange(3, "line_id").sortWithinPartitions("line_id")
        part.select("line").write.text(home)
        fs = path(home).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for found in fs.globStatus(path(f"{home}/part-*")):
            number = found.getPath().getName().split("-")[1]
            fs.rename(found.getPath(), path(f"{home}/messages.{number}"))
    lines = src.read_logs(spark, [f"{folder}/h1", f"{folder}/h2"])
    return (src.number_lines(lines, ws, "number")
            .select(F.regexp_extract("path", "/(h[12])/", 1).alias("h"), "number", "value"))


@query("combine_csv", "SELECT CAST(event_id AS STRING) AS event_id, event_type, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS STRING) END AS user_id FROM events")
def combine_csv(spark, sf, ws):
    """Events in two kinds of file, one without user_id."""
    folder, events = ws.path("csv"), table(spark, sf, "events")
    even = F.col("event_id") % 2 == 0
    events.filter(even).select("event_id", "event_type", "user_id").write.csv(f"{folder}/a", header=True)
    events.filter(~even).select("event_id", "event_type").write.csv(f"{folder}/b", header=True)
    return src.union_csv(spark, f"{folder}/*/*.csv").select("event_id", "event_type", "user_id")


def mined_lines(spark, sf, ws):
    lines = parse_preset(logs(spark, sf), LINUX, "line", keep=["line_id"])
    found = tm.mine(lines, LINUX, ws)
    return found, found.events(lines)


MINED_SQL = sql("SELECT CAST(line_id AS STRING) AS line_id, content, event_id, event_template FROM tpl JOIN ev USING (event_template) JOIN logs USING (line_id)", *CHAIN)


@query("read_structured_csv", MINED_SQL)
def read_structured_csv(spark, sf, ws):
    path = ws.path("structured")
    sinks.write_structured(mined_lines(spark, sf, ws)[1], path, "csv")
    return src.read_structured(spark, path).select("line_id", "content", "event_id", "event_template")


@query("write_structured", MINED_SQL)
def write_structured(spark, sf, ws):
    path = ws.path("structured")
    sinks.write_structured(mined_lines(spark, sf, ws)[1], path)
    return spark.read.parquet(path).select(F.col("line_id").cast("string"), "content", "event_id", "event_template")


@query("write_templates", sql("SELECT event_id, event_template, CAST(occurrences AS STRING) AS occurrences FROM ev", *CHAIN))
def write_templates(spark, sf, ws):
    path = ws.path("templates")
    sinks.write_templates(mined_lines(spark, sf, ws)[0].catalogue, path, "csv")
    return src.read_structured(spark, path)


@query("write_reports", sql(f"SELECT {LOG}, {RECORD}, (SELECT count(*) FROM rws) AS total_logs, (SELECT round(t_seq, 6) FROM thr) AS sequential_threshold, "
                           "(SELECT count(*) FROM single) AS single_log_count FROM anom", *FULL))
def write_reports(spark, sf, ws):
    """All three outputs read back: records of both modes, and the figures of the run beside them."""
    folder = ws.path("reports")
    found = stored(spark, sf)[1]
    sinks.write_reports(found, folder)
    single = spark.read.schema(found.single.schema).json(f"{folder}/single_log_anomalies")
    sequences = spark.read.schema(found.sequential.schema).json(f"{folder}/sequential_anomalies")
    records = dt.export_records(dt.union_modes(single, sequences))
    figures = spark.read.json(f"{folder}/run").select("total_logs", "sequential_threshold", "single_log_count").first()
    back = records.select("log.*", "anomaly_type", "severity", "confidence", "anomaly_score", "processing_mode", "timestamp",
                          *[F.lit(v).alias(k) for k, v in figures.asDict().items()])
    return rounded(back, "confidence", "anomaly_score", "sequential_threshold")


NOW = "TIMESTAMP '2024-03-01 10:20:30'"
GAPPED = "CASE WHEN CAST(line_id AS BIGINT) % 3 = 0 THEN NULL WHEN CAST(line_id AS BIGINT) % 3 = 1 THEN '' ELSE timestamp END"


@query("anomaly_store_append", sql(f"SELECT line_id, anomaly_type, coalesce(nullif({GAPPED}, ''), '10:20:30') AS timestamp FROM anom", *FULL))
def anomaly_store_append(spark, sf, ws):
    path = ws.path("store")
    records = dt.export_records(anomalies(spark, sf)).withColumn("line_id", F.col("log.line_id").cast("long"))
    records = records.withColumn("timestamp", F.expr(GAPPED))
    for mode in ("single_log", "sequential"):
        sinks.append_anomalies(records.filter(F.col("processing_mode") == mode), path, F.expr(NOW))
    return spark.read.parquet(path).select("line_id", "anomaly_type", "timestamp")


@query("export_sink", sql(f"SELECT {LOG}, anomaly_type, severity FROM anom", *FULL))
def export_sink(spark, sf, ws):
    path, records = ws.path("export"), dt.export_records(anomalies(spark, sf))
    sinks.export_batch(records, lambda df: df.write.mode("overwrite").parquet(path))
    return spark.read.parquet(path).select("log.*", "anomaly_type", "severity")


POSTED = ("CASE WHEN k % 3 = 0 THEN '[{\"anomaly_type\": \"' || branch || '\", \"confidence\": 0.5, \"log\": {\"line_id\": \"' || CAST(line_id AS STRING) || '\"}}]' "
          "WHEN k % 3 = 1 THEN '{\"anomaly_type\": \"' || branch || '\"}' ELSE '[broken' END")


@query("payload_gate", sql("SELECT line_id, k % 3 = 0 AS accepted, CASE WHEN k % 3 = 0 THEN branch END AS anomaly_type, CASE WHEN k % 3 = 0 THEN CAST(line_id AS STRING) END AS log_line FROM logs"))
def payload_gate(spark, sf, ws):
    posted = logs(spark, sf).select("line_id", F.expr(POSTED).alias("value"))
    good = pl.accept_payloads(posted).select("line_id", F.lit(True).alias("accepted"), "anomaly_type", F.col("log.line_id").alias("log_line"))
    bad = pl.reject_payloads(posted).select("line_id", F.lit(False).alias("accepted"), F.lit(None).cast("string").alias("anomaly_type"),
                                            F.lit(None).cast("string").alias("log_line"))
    return good.unionByName(bad)


# ---- scorers over the embeddings ----------------------------------------------------------------

def vectors(spark, sf, ws):
    rows = index_rows(table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x")), ["vec_id"], ws)
    return rows, rows.count()


# With no direction kept, the error is the mean squared distance from the mean.
SPREAD = ("v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS d FROM embeddings), "
          "m AS (SELECT d, avg(x) AS mu FROM v GROUP BY d), "
          "r AS (SELECT vec_id, avg((x - mu) * (x - mu)) AS err FROM v JOIN m USING (d) GROUP BY vec_id), "
          "i AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS idx FROM r)")


@query("score_baseline", f"WITH {SPREAD} SELECT idx // 8 AS win_id, round(avg(err), 6) AS err FROM i WHERE (idx // 8) * 8 < (SELECT count(*) FROM r) - 8 GROUP BY ALL")
def score_baseline(spark, sf, ws):
    """The single-log scorer with no direction kept: its error can be checked by value."""
    rows, n = vectors(spark, sf, ws)
    return rounded(sc.single_errors(rows, n, "x", sc.Reconstruction.fit(rows, "x", 0)), "err")


# Squarings of a matrix that leave the direction of its largest value alone.
SQUARINGS = 18


def leading_sql(k: int) -> str:
    """CTE ``lead``: the sum of the projections on the k leading directions of the matrix ``a`` of ``cov``, and what is left
    of it, by repeated multiplication."""
    trace = lambda m: f"list_sum(list_transform({m}, lambda q, i: q[i]))"
    less = lambda m, other, factor: (f"list_transform({m}, lambda q, i: list_transform(q, lambda e, j: e {factor} * ({other}[i][j])))")
    value = "list_sum(list_transform(a, lambda q, i: list_dot_product(q, m[i])))"
    return (f"lead AS (WITH RECURSIVE p AS (SELECT 0 AS step, a, list_transform(a, lambda q: list_transform(q, lambda e: e / {trace('a')})) AS m, "
            "list_transform(a, lambda q: list_transform(q, lambda e: 0::DOUBLE)) AS held FROM cov "
            "UNION ALL SELECT step + 1, a2, CASE WHEN done THEN list_transform(a2, lambda q: list_transform(q, lambda e: e / t)) "
            "ELSE list_transform(m2, lambda q: list_transform(q, lambda e: e / t)) END, held2 FROM ("
            f"SELECT *, {trace('CASE WHEN done THEN a2 ELSE m2 END')} AS t FROM (SELECT step, done, m2, "
            f"CASE WHEN done THEN {less('a', 'm', '- lam')} ELSE a END AS a2, CASE WHEN done THEN {less('held', 'm', '+ 1')} ELSE held END AS held2 "
            f"FROM (SELECT *, step % {SQUARINGS + 1} = {SQUARINGS} AS done, {value} AS lam, "
            "list_transform(m, lambda q: list_transform(m, lambda e: list_dot_product(q, e))) AS m2 FROM p "
            f"WHERE step < {k * (SQUARINGS + 1)}))) ) SELECT a, held FROM p WHERE step = {k * (SQUARINGS + 1)})")


# Rows less their mean, and their covariance as a list of lists.
CENTRED = ("v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS d FROM embeddings), "
           "m AS (SELECT d, avg(x) AS mu FROM v GROUP BY d), "
           "z AS (SELECT vec_id, list(x - mu ORDER BY d) AS z FROM v JOIN m USING (d) GROUP BY vec_id), "
           "w AS (SELECT d, list(x - mu ORDER BY vec_id) AS w FROM v JOIN m USING (d) GROUP BY d), "
           "cov AS (SELECT list(r ORDER BY d) AS a FROM (SELECT a.d, list(list_dot_product(a.w, b.w) / len(a.w) ORDER BY b.d) AS r "
           "FROM w a, w b GROUP BY a.d))")
INSIDE = "list_dot_product(z, list_transform(held, lambda q: list_dot_product(q, z)))"
SINGLE = (f"WITH {CENTRED}, {leading_sql(16)}, r AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS idx, "
          f"(list_dot_product(z, z) - {INSIDE}) / len(z) AS err FROM z, lead) "
          "SELECT idx // 8 AS win_id, round(avg(err), 6) AS err FROM r WHERE (idx // 8) * 8 < (SELECT count(*) FROM r) - 8 GROUP BY ALL")
# Products of whole windows instead of the covariance: what the leading directions leave of them is the error.
SEQUENTIAL = (
    "WITH i AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS idx, count(*) OVER () AS n, embedding FROM embeddings), "
    "v AS (SELECT idx // 8 AS win_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) + (idx % 8) * len(embedding) AS d "
    "FROM i WHERE (idx // 8) * 8 < n - 8), m AS (SELECT d, avg(x) AS mu FROM v GROUP BY d), "
    "z AS (SELECT win_id, list(x - mu ORDER BY d) AS z FROM v JOIN m USING (d) GROUP BY win_id), "
    "cov AS (SELECT list(r ORDER BY win_id) AS a FROM (SELECT a.win_id, list(list_dot_product(a.z, b.z) ORDER BY b.win_id) AS r "
    f"FROM z a, z b GROUP BY a.win_id)), {leading_sql(16)} "
    "SELECT win_id, round(a[row_number() OVER (ORDER BY win_id)][row_number() OVER (ORDER BY win_id)] / len(z), 6) AS err FROM z, lead")
PCA_NORM = (f"WITH {CENTRED}, {leading_sql(2)}, r AS (SELECT vec_id, sqrt({INSIDE}) AS score FROM z, lead) "
            "SELECT vec_id, round(score, 6) AS score, CASE WHEN score > (SELECT quantile_cont(score, 0.95) FROM r) THEN -1 ELSE 1 END AS prediction FROM r")


@query("score_single", SINGLE)
def score_single(spark, sf, ws):
    rows, n = vectors(spark, sf, ws)
    return rounded(sc.single_errors(rows, n, "x", sc.Reconstruction.fit(rows, "x", 16)), "err")


@query("score_sequential", SEQUENTIAL)
def score_sequential(spark, sf, ws):
    rows, n = vectors(spark, sf, ws)
    windows = ws.stage(sc.flat_windows(rows, n, "x"), "windows")
    return rounded(sc.sequential_errors(windows, sc.Reconstruction.fit(windows, "window", 16)), "err")


def forest_sql(trees: int = 100, sample: int = 256, seed: int = 42, depth: int = 8) -> str:
    """The whole forest in SQL: the draws of each tree, its nodes level by level, and every row's walk through all trees."""
    span = sc.SPAN
    digits = lambda at: f"CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR)), {at}, {sc.HASH_DIGITS}) AS BIGINT)"
    part = lambda which: f"CAST('0x' || substr(md5('{seed}:' || t || ':' || node || ':{which}'), 1, 12) AS BIGINT)"
    mean = lambda n: f"CASE WHEN {n} <= 1 THEN 0 WHEN {n} = 2 THEN 1 ELSE 2 * (ln({n} - 1) + {np.euler_gamma!r}) - 2 * ({n} - 1) / {n}::DOUBLE END"
    steps = [f"v AS (SELECT vec_id, CAST(vec_id AS VARCHAR) AS k, embedding::DOUBLE[] AS x, {digits(1)} AS h1, {digits(1 + sc.HASH_DIGITS)} AS h2 FROM embeddings)",
             f"d(t, a, b, c) AS (VALUES {', '.join(map(str, sc.tree_draws(trees, seed)))})",
             f"y AS (SELECT t, k, x, (a * h1 + b * h2 + c) % {span} AS drawn, (SELECT count(*) FROM v) AS n FROM v, d)",
             f"z AS (SELECT * FROM y WHERE drawn < CASE WHEN n <= {4 * sample} THEN {span} ELSE ceil({span} * ({4.0 * sample} / n)) END "
             f"QUALIFY row_number() OVER (PARTITION BY t ORDER BY drawn, k) <= {sample})",
             "p0 AS (SELECT t, 0 AS node, x, CAST(ceil(log2(greatest(count(*) OVER (PARTITION BY t), 2))) AS INT) AS most FROM z)"]
    for at in range(depth + 1):
        steps += [f"u{at} AS (SELECT t, node, most, unnest(x) AS e, unnest(range(len(x))) AS f FROM p{at})",
                  f"r{at} AS (SELECT t, node, any_value(most) AS most, f, min(e) AS lo, max(e) AS hi, count(*) AS n FROM u{at} GROUP BY t, node, f)",
                  f"o{at} AS (SELECT t, node, any_value(most) AS most, any_value(n) AS n, "
                  f"coalesce(list({{'f': f, 'lo': lo, 'hi': hi}} ORDER BY f) FILTER (hi > lo), []) AS o FROM r{at} GROUP BY t, node)",
                  f"q{at} AS (SELECT t, node, n, CASE WHEN {at} < most AND len(o) > 0 THEN o[1 + {part('f')} % len(o)] END AS q FROM o{at})",
                  f"n{at} AS MATERIALIZED (SELECT t, node, q.f AS f, q.lo + (q.hi - q.lo) * ({part('c')} / {2.0 ** 48!r}) AS cut, "
                  f"{at} + {mean('n')} AS path FROM q{at})",
                  f"p{at + 1} AS MATERIALIZED (SELECT t, 2 * node + CASE WHEN x[f + 1] <= cut THEN 1 ELSE 2 END AS node, x, most FROM p{at} JOIN n{at} USING (t, node) WHERE f IS NOT NULL)"]
    nodes = " UNION ALL ".join(f"SELECT * FROM n{at}" for at in range(depth + 1))
    return (f"WITH RECURSIVE {', '.join(steps)}, nodes AS MATERIALIZED ({nodes}), "
            "walk AS (SELECT vec_id, t, 0 AS node FROM v, d UNION ALL SELECT w.vec_id, w.t, 2 * w.node + CASE WHEN v.x[g.f + 1] <= g.cut THEN 1 ELSE 2 END "
            "FROM walk w JOIN nodes g ON g.t = w.t AND g.node = w.node JOIN v ON v.vec_id = w.vec_id WHERE g.f IS NOT NULL), "
            "s AS (SELECT vec_id, sum(path ORDER BY t) AS total FROM walk JOIN nodes USING (t, node) WHERE f IS NULL GROUP BY vec_id), "
            f"r AS (SELECT vec_id, -pow(2.0, -(total / {trees}) / (SELECT {mean(f'least({sample}, count(*))')} FROM v)) AS score FROM s) "
            "SELECT vec_id, round(score, 6) AS score, CASE WHEN score < (SELECT quantile_cont(score, 0.05) FROM r) THEN -1 ELSE 1 END AS prediction FROM r")


@query("isolation_forest", forest_sql())
def isolation_forest(spark, sf, ws):
    return rounded(sc.isolation_forest(vectors(spark, sf, ws)[0], "vec_id", "x", ws), "score")


def kernel_sql(d: int) -> str:
    """The frequencies as literals; angles, mean waves and every row's product with them in SQL."""
    waves = ", ".join(map(str, sc.kernel_frequencies(d).tolist()))
    return (f"WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), f AS (SELECT unnest([{waves}]) AS w), "
            "g AS (SELECT sqrt(2 / (any_value(d) * var_pop(e))) AS scale FROM (SELECT len(x) AS d, unnest(x) AS e FROM v)), "
            "j AS (SELECT row_number() OVER () AS j, w FROM f), "
            "a AS MATERIALIZED (SELECT vec_id, j, list_dot_product(x, w) * scale AS a FROM v, j, g), "
            "c AS (SELECT j, avg(cos(a)) AS c, avg(sin(a)) AS s FROM a GROUP BY j), "
            "r AS (SELECT vec_id, avg(cos(a) * c + sin(a) * s) AS score FROM a JOIN c USING (j) GROUP BY vec_id) "
            "SELECT vec_id, round(score, 6) AS score, CASE WHEN score < (SELECT quantile_cont(score, 0.05) FROM r) THEN -1 ELSE 1 END AS prediction FROM r")


# Dimensions of the embeddings.
DIMENSIONS = 64


@query("rbf_novelty", kernel_sql(DIMENSIONS))
def rbf_novelty(spark, sf, ws):
    return rounded(sc.rbf_novelty(vectors(spark, sf, ws)[0], "vec_id", "x", ws), "score")


@query("pca_norm", PCA_NORM)
def pca_norm(spark, sf, ws):
    return rounded(sc.pca_norm(vectors(spark, sf, ws)[0], "vec_id", "x", ws), "score")


# ---- streams ------------------------------------------------------------------------------------

def event_stream(spark, sf):
    """The events table as a stream of log lines."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = streams.stream_parquet(spark, sf, schema, "events.parquet")
    return spark.sql(LINE_SQL.replace("{logs}", LOGS_SQL), events=events)


def payload_stream(spark, sf):
    return event_stream(spark, sf).select(F.expr(PAYLOAD).alias("value"))


def finish(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def typed_stream(spark, sf):
    rows = event_stream(spark, sf).withColumn("event_template", F.regexp_replace("content", "[0-9]+", "<*>"))
    return with_log_type(rows, "anomaly_type").select("line_id", "ts", "host", "component", "value", "anomaly_type")


@query("kafka_source", sql("SELECT value, count(*) AS n FROM payloads GROUP BY ALL", COLLECT[0]))
def kafka_source(spark, sf, ws):
    """Payloads as a stream of text files, the stand-in for the topic."""
    folder, out = ws.path("topic"), ws.path("consumed")
    payloads(spark, sf).select("value").write.text(folder)
    stream = streams.stream_text(spark, folder, files_per_batch=2)
    finish(jobs.each_batch(stream, lambda df, b: jobs.write_batch(df, out, b), ws.path("checkpoint")))
    return spark.read.parquet(out).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("stream_parse", sql(f"SELECT route, output, count(*) AS n FROM (SELECT route, {OUTPUT} AS output FROM routed) t WHERE output IS NOT NULL GROUP BY ALL", *COLLECT))
def stream_parse(spark, sf, ws):
    out = ws.path("lines")
    finish(jobs.stream_parse(payload_stream(spark, sf), out, ws.path("checkpoint")))
    return spark.read.parquet(out).groupBy("route", "output").agg(F.count(F.lit(1)).alias("n"))


@query("stream_route", sql(f"SELECT route IN ('unrecognized', 'invalid') AS dead, route, count(*) AS n FROM (SELECT route, {OUTPUT} AS output FROM routed) t "
                           "WHERE output IS NOT NULL OR route = 'invalid' GROUP BY ALL", *COLLECT))
def stream_route(spark, sf, ws):
    out, dead = ws.path("lines"), ws.path("dead")
    finish(jobs.stream_route(payload_stream(spark, sf), out, dead, ws.path("checkpoint")))
    count = lambda path, flag: spark.read.parquet(path).groupBy(F.lit(flag).alias("dead"), "route").agg(F.count(F.lit(1)).alias("n"))
    return count(out, False).unionByName(count(dead, True))


@query("stream_alert", sql("SELECT line_id, component, round(value, 6) AS value, round(t, 6) AS threshold FROM logs JOIN (SELECT component, quantile_cont(value, 0.95) AS t FROM logs GROUP BY ALL) x USING (component) WHERE value > t"))
def stream_alert(spark, sf, ws):
    limits = percentiles(logs(spark, sf), "value", [0.95], ws, by=["component"])
    limits = ws.stage(limits.select("component", F.get("pct", F.lit(0)).alias("threshold")), "thresholds")
    alerts = jobs.stream_alert(event_stream(spark, sf).select("line_id", "component", "value"), limits, ["component"], "value")
    out = ws.path("alerts")
    finish(jobs.each_batch(alerts, lambda df, b: jobs.write_batch(df, out, b), ws.path("checkpoint")))
    return rounded(spark.read.parquet(out).select("line_id", "component", "value", "threshold"), "value", "threshold")


COUNT_WINDOWS = sql("SELECT host, win_id, \"offset\", line_id FROM (SELECT host, line_id, (rn // 8) AS win_id, rn % 8 AS \"offset\", n FROM (SELECT host, line_id, row_number() OVER (PARTITION BY host ORDER BY line_id) - 1 AS rn, "
                                   "count(*) OVER (PARTITION BY host) AS n FROM logs) a) b WHERE (win_id + 1) * 8 <= n")


@query("stream_count_windows", COUNT_WINDOWS)
def stream_count_windows_query(spark, sf, ws):
    """Complete windows of eight consecutive lines per host."""
    out = ws.path("windows")
    stream = event_stream(spark, sf).select("line_id", "host")
    finish(stream_count_windows(stream, "host", ["line_id"], out, ws.path("carry"), ws.path("checkpoint")))
    return spark.read.parquet(out).select("host", "win_id", "offset", "line_id")


@query("stream_count_windows_state", COUNT_WINDOWS)
def stream_count_windows_state(spark, sf, ws):
    """The same windows from Spark's state store."""
    out = ws.path("windows")
    windows = state_count_windows(event_stream(spark, sf).select("line_id", "host"), "host", ["line_id"])
    finish(jobs.each_batch(windows, lambda df, b: jobs.write_batch(df, out, b), ws.path("checkpoint")))
    return spark.read.parquet(out).select("host", "win_id", "offset", "line_id")


@query("stream_fanout", sql("SELECT 'store' AS viewer, line_id, log_type AS anomaly_type, '10:20:30' AS timestamp FROM verdict WHERE log_type <> 'normal' UNION ALL "
                            "SELECT 'panel', line_id, log_type, '10:20:30' FROM verdict WHERE log_type <> 'normal'", LABELED_CTE, VERDICT_CTE))
def stream_fanout(spark, sf, ws):
    paths = {v: ws.path(v) for v in ("store", "panel")}
    found = typed_stream(spark, sf).filter("anomaly_type <> 'normal'").select("line_id", "anomaly_type", F.lit("").alias("timestamp"))
    viewers = {v: (lambda p: lambda df, b: jobs.write_batch(df, p, b))(p) for v, p in paths.items()}
    finish(jobs.stream_fanout(found, viewers, ws.path("checkpoint"), F.expr(NOW)))
    parts = [spark.read.parquet(p).select(F.lit(v).alias("viewer"), "line_id", "anomaly_type", "timestamp") for v, p in paths.items()]
    return parts[0].unionByName(parts[1])


@query("stream_threat_counts", sql("SELECT log_type AS anomaly_type, count(*) AS n FROM verdict WHERE log_type <> 'normal' GROUP BY ALL", LABELED_CTE, VERDICT_CTE))
def stream_threat_counts(spark, sf, ws):
    out = ws.path("totals")
    finish(jobs.stream_threat_counts(typed_stream(spark, sf), out, ws.path("checkpoint")))
    return jobs.latest_counts(spark, out, ["anomaly_type"])


@query("stream_windowed_counts", sql("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, log_type AS anomaly_type, count(*) AS n FROM verdict GROUP BY ALL", LABELED_CTE, VERDICT_CTE))
def stream_windowed_counts(spark, sf, ws):
    out = ws.path("panel")
    stream = typed_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    finish(jobs.stream_windowed_counts(stream, out, ws.path("checkpoint")))
    counts = jobs.latest_counts(spark, out, ["start", "anomaly_type"])
    return counts.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("batch_run")
def batch_run(spark, sf, ws):
    """The whole run over all lines as text: parse, mine, features, scores, labels."""
    from ..plans.batch import analyze_logs
    lines = src.read_logs(spark, text_folder(spark, sf, ws))
    return rounded(analyze_logs(lines, "Linux", ws).detection.anomalies().select(
        "processing_mode", "anomaly_type", "severity", "confidence", "anomaly_score", "timestamp", "win_id", "position"),
        "confidence", "anomaly_score")


@query("score_saved")
def score_saved(spark, sf, ws):
    """Learn from all lines, save, load, and score the same parsed table with what was loaded."""
    from ..plans.trained import Trained
    table_ = ws.stage(mined_lines(spark, sf, ws)[1], "parsed")
    folder = ws.path("trained")
    Trained.fit(table_, ws).save(spark, folder)
    found = Trained.load(spark, folder).score(table_, ws)
    return rounded(found.anomalies().select("processing_mode", "anomaly_type", "severity", "confidence", "anomaly_score", "win_id", "position"),
                   "confidence", "anomaly_score")
