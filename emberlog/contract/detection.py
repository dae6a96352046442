"""Queries and oracles of windows, detection, severity, analytics and the dashboard.

The events' ``value`` stands in for the errors of a scorer, so that everything after scoring can be
checked by value.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.severity import severity, severity_confidence
from ..operators import analytics as an, dashboard as db, detect as dt
from ..operators.classify import with_log_type
from ..operators.indexing import index_rows, percentiles
from ..operators.windows import keyed_windows, place_rows, sequence_windows, window_error
from ..plans.rulebook import RULES, SEVERITY_LABELS, THREAT_TYPES, WEIGHTS
from ..workspace import Workspace
from .base import logs, query, quoted, sql, table
from .text import LABELED_CTE, VERDICT_CTE, templated

ERRORS = {"sequential": "sequential_error", "single_log": "single_error"}


def scored(spark, sf, ws):
    """Templated logs with their position and two errors per row; and the number of rows."""
    rows = templated(spark, sf).select(
        "line_id", "ts", F.right("stamp", F.lit(8)).alias("time"), F.col("host").alias("level"), "component", "content",
        "event_template", F.col("value").alias("sequential_error"), F.abs(F.col("value") - 50).alias("single_error"))
    rows = index_rows(rows, ["line_id"], ws)
    return rows, rows.count()


ROWS = ("rws AS (SELECT *, row_number() OVER (ORDER BY line_id) - 1 AS idx, value AS sequential_error, abs(value - 50) AS single_error, "
        "right(stamp, 8) AS time, host AS level FROM verdict)")
WINS = ("wins AS MATERIALIZED (SELECT idx // 8 AS win_id, (idx // 8) * 8 AS start_idx, avg(sequential_error) AS sequential_error, avg(single_error) AS single_error "
        "FROM rws WHERE (idx // 8) * 8 < (SELECT count(*) FROM rws) - 8 GROUP BY ALL)")
THR = ("thr AS (SELECT quantile_cont(sequential_error, 0.95) AS t_seq, quantile_cont(single_error, 0.95) AS t_single FROM wins)")
SEV = ("errs AS (SELECT sequential_error AS e FROM wins UNION ALL SELECT single_error FROM wins), "
       "sev AS (SELECT quantile_cont(e, 0.85) AS p85, quantile_cont(e, 0.95) AS p95, quantile_cont(e, 0.99) AS p99 FROM errs)")
LABEL = "CASE WHEN e > p99 THEN 'Critical' WHEN e > p95 THEN 'High' WHEN e > p85 THEN 'Medium' ELSE 'Low' END"
CONF = ("least(1.0::DOUBLE, greatest(0.1::DOUBLE, CASE WHEN e > p99 THEN least(1.0::DOUBLE, (e - p99) / p99 + 0.5::DOUBLE) "
        "WHEN e > p95 THEN least(1.0::DOUBLE, (e - p95) / p95 + 0.5::DOUBLE) WHEN e > p85 THEN least(1.0::DOUBLE, (e - p85) / p85 + 0.5::DOUBLE) "
        "ELSE greatest(0.1::DOUBLE, 1.0::DOUBLE - e / p85) END))")
SINGLE = ("single AS MATERIALIZED (SELECT r.*, w.win_id, w.single_error AS e, p85, p95, p99 FROM rws r JOIN wins w ON r.idx // 8 = w.win_id, thr, sev "
          "WHERE w.single_error > t_single AND r.log_type <> 'normal')")
SEQ = ("seqrows AS (SELECT r.*, w.win_id, w.start_idx, w.sequential_error AS e, r.idx - w.start_idx AS off FROM rws r JOIN wins w ON r.idx // 8 = w.win_id, thr "
       "WHERE w.sequential_error > t_seq), "
       "dom AS (SELECT win_id, log_type, row_number() OVER (PARTITION BY win_id ORDER BY count(*) DESC, min(off)) AS rn FROM seqrows "
       "WHERE log_type <> 'normal' GROUP BY win_id, log_type), "
       "seq AS MATERIALIZED (SELECT s.win_id, s.start_idx, d.log_type AS dominant, s.e, any_value(p85) AS p85, any_value(p95) AS p95, any_value(p99) AS p99, "
       "count(*) AS n_logs, sum(CASE WHEN s.log_type <> 'normal' THEN 1 ELSE 0 END) AS non_normal, arg_min(s.time, off) AS time, "
       "string_agg(s.content, '|' ORDER BY off) AS contents, string_agg(CAST(s.line_id AS STRING), '|' ORDER BY off) AS line_ids, min(s.ts) AS ts, "
       "arg_min(s.content, off) AS content, arg_min(s.event_template, off) AS event_template, arg_min(s.level, off) AS level, "
       "arg_min(s.component, off) AS component, arg_min(s.line_id, off) AS line_id "
       "FROM seqrows s JOIN dom d ON d.win_id = s.win_id AND d.rn = 1, sev GROUP BY s.win_id, s.start_idx, d.log_type, s.e)")
ANOM = ("anom AS MATERIALIZED (SELECT 'single_log' AS processing_mode, log_type AS anomaly_type, " + LABEL + " AS severity, " + CONF + " AS confidence, e AS anomaly_score, "
        "time AS timestamp, content, event_template, level, component, line_id, idx AS position, win_id, ts, content AS contents FROM single "
        "UNION ALL SELECT 'sequential', dominant, " + LABEL + ", " + CONF + ", e, time, content, event_template, level, component, line_id, start_idx, win_id, ts, contents FROM seq)")
BASE = [LABELED_CTE, VERDICT_CTE, ROWS]
W = [*BASE, WINS]
FULL = [*W, THR, SEV, SINGLE, SEQ, ANOM]
# Order of arrival in the store: single anomalies first, then sequences, each by position.
STORE = ("store AS (SELECT *, row_number() OVER (ORDER BY processing_mode DESC, position) - 1 AS seq FROM anom)")


def r6(*columns):
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def run(spark, sf, ws, mode="both"):
    rows, n = scored(spark, sf, ws)
    return dt.detect(rows, n, ws, mode)


_stores: dict[tuple[str, str], tuple] = {}


def stored(spark, sf):
    """The written anomaly table of one detection run, read by all report queries of a session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _stores:
        ws = Workspace(spark)
        found = run(spark, sf, ws)
        rows = found.anomalies()
        # 'single_log' before 'sequential', as they arrive.
        arrival = F.when(F.col("processing_mode") == "single_log", 0).otherwise(1)
        rows = index_rows(rows.withColumn("_arrival", arrival), ["_arrival", "position"], ws, "seq").drop("_arrival")
        _stores[key] = (ws.stage(rows, "anomalies"), found)
    return _stores[key]


def anomalies(spark, sf):
    return stored(spark, sf)[0]


LIMITS = ("sequential_threshold", "single_log_threshold", "hybrid_threshold")


# ---- windows ------------------------------------------------------------------------------------

@query("sequence_windows", sql(
    "SELECT line_id, start_idx // 4 AS win_id, start_idx, idx - start_idx AS \"offset\" FROM rws, "
    "(SELECT unnest(range(0, (SELECT count(*) FROM logs) - 8, 4)) AS start_idx) s WHERE idx >= start_idx AND idx < start_idx + 8", *BASE))
def sequence_windows_query(spark, sf, ws):
    """Overlapping windows: 8 rows every 4."""
    rows, n = scored(spark, sf, ws)
    return sequence_windows(rows.select("line_id", "idx"), n, 8, 4).select("line_id", "win_id", "start_idx", "offset")


KEYED = ("placed AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY line_id) - 1 AS kidx, count(*) OVER (PARTITION BY level) AS kn, "
         "row_number() OVER (ORDER BY level, line_id) - 1 AS place FROM rws)")


@query("sequence_windows_by_key", sql(
    "SELECT level AS host, line_id, s AS win_id, s * 8 AS start_idx, kidx - s * 8 AS \"offset\" FROM (SELECT *, kidx // 8 AS s FROM placed) t WHERE (s + 1) * 8 <= kn", *BASE, KEYED))
def sequence_windows_by_key(spark, sf, ws):
    """The complete windows of each host, as a stream of the same lines has them."""
    rows = logs(spark, sf).select("line_id", "host")
    return keyed_windows(rows, "host", ["line_id"], ws).select("host", "line_id", "win_id", "start_idx", "offset")


@query("sequence_windows_by_key_overlapping", sql(
    "SELECT level AS host, line_id, s AS win_id, s * 4 AS start_idx, kidx - s * 4 AS \"offset\" FROM (SELECT *, unnest(range(greatest(0, (kidx - 4) // 4), kidx // 4 + 1)) AS s FROM placed) t "
    "WHERE kidx >= s * 4 AND kidx < s * 4 + 8 AND s * 4 + 8 <= kn", *BASE, KEYED))
def sequence_windows_by_key_overlapping(spark, sf, ws):
    """Windows of eight lines of a host, every four."""
    rows = logs(spark, sf).select("line_id", "host")
    return keyed_windows(rows, "host", ["line_id"], ws, 8, 4).select("host", "line_id", "win_id", "start_idx", "offset")


@query("window_error", sql(f"SELECT win_id, start_idx, {r6('sequential_error', 'single_error')} FROM wins", *W))
def window_error_query(spark, sf, ws):
    rows, n = scored(spark, sf, ws)
    return rounded(window_error(sequence_windows(rows, n), *ERRORS.values()), *ERRORS.values())


@query("join_window_logs", sql("SELECT w.win_id, line_id, round(w.sequential_error, 6) AS anomaly_score FROM rws r JOIN wins w ON r.idx // 8 = w.win_id, thr "
                               "WHERE w.sequential_error > t_seq", *W, THR))
def join_window_logs(spark, sf, ws):
    rows, n = scored(spark, sf, ws)
    windows = sequence_windows(rows, n)
    errors = ws.stage(window_error(windows, "sequential_error"), "errors")
    flagged = dt.flag_windows(errors, "sequential_error", dt.flag_threshold(errors, "sequential_error", ws))
    return rounded(dt.join_window_logs(windows, flagged, "sequential_error").select("win_id", "line_id", "anomaly_score"), "anomaly_score")


@query("score_hybrid", sql("SELECT win_id, round(0.6::DOUBLE * sequential_error + 0.4::DOUBLE * single_error, 6) AS hybrid_error FROM wins", *W))
def score_hybrid(spark, sf, ws):
    from ..operators.detect import hybrid_error
    rows, n = scored(spark, sf, ws)
    errors = window_error(sequence_windows(rows, n), *ERRORS.values())
    return rounded(errors.select("win_id", hybrid_error(F.col("sequential_error"), F.col("single_error")).alias("hybrid_error")), "hybrid_error")


MODELS = ("models AS (SELECT win_id, 'sequential' AS model_id, sequential_error AS err FROM wins UNION ALL SELECT win_id, 'single', single_error FROM wins), "
          "losses AS (SELECT model_id, avg(err) AS loss FROM models GROUP BY ALL), "
          "wts AS (SELECT model_id, (1 / loss) / (SELECT sum(1 / loss) FROM losses) AS w FROM losses)")


def model_errors(spark, sf, ws):
    rows, n = scored(spark, sf, ws)
    errors = window_error(sequence_windows(rows, n), *ERRORS.values())
    pairs = F.array(F.struct(F.lit("sequential").alias("model_id"), F.col("sequential_error").alias("err")),
                    F.struct(F.lit("single").alias("model_id"), F.col("single_error").alias("err")))
    return ws.stage(errors.select("win_id", F.inline(pairs)), "model_errors")


@query("ensemble_weights", sql("SELECT model_id, round(w, 6) AS w FROM wts", *W, MODELS))
def ensemble_weights(spark, sf, ws):
    losses = model_errors(spark, sf, ws).groupBy("model_id").agg(F.avg("err").alias("loss"))
    return rounded(dt.ensemble_weights(losses), "w")


@query("ensemble_average", sql("SELECT win_id, round(sum(w * err) / sum(w), 6) AS err FROM models JOIN wts USING (model_id) GROUP BY ALL", *W, MODELS))
def ensemble_average(spark, sf, ws):
    errors = model_errors(spark, sf, ws)
    weights = dt.ensemble_weights(errors.groupBy("model_id").agg(F.avg("err").alias("loss")))
    return rounded(dt.ensemble(errors, weights), "err")


# ---- thresholds and severity --------------------------------------------------------------------

def window_errors(spark, sf, ws):
    rows, n = scored(spark, sf, ws)
    return ws.stage(window_error(sequence_windows(rows, n), *ERRORS.values()), "window_errors")


@query("flag_threshold", sql("SELECT round(t_seq, 6) AS sequential, round(t_single, 6) AS single_log FROM thr", *W, THR))
def flag_threshold(spark, sf, ws):
    errors = window_errors(spark, sf, ws)
    pair = [percentiles(errors, c, [0.95], ws).select(F.lit(1).alias("k"), F.round(F.get("pct", F.lit(0)), 6).alias(m))
            for m, c in ERRORS.items()]
    return pair[0].join(pair[1], "k").drop("k")


@query("flag_windows", sql("SELECT win_id, round(single_error, 6) AS single_error FROM wins, thr WHERE single_error > t_single", *W, THR))
def flag_windows(spark, sf, ws):
    errors = window_errors(spark, sf, ws)
    limit = dt.flag_threshold(errors, "single_error", ws)
    return rounded(dt.flag_windows(errors, "single_error", limit).select("win_id", "single_error"), "single_error")


def learned(spark, sf, ws):
    errors = window_errors(spark, sf, ws)
    both = errors.select("win_id", F.explode(F.array(*ERRORS.values())).alias("e"))
    return both, dt.SeverityModel.fit(both, "e", ws)


@query("learn_severity", sql("SELECT round(p85, 6) AS p85, round(p95, 6) AS p95, round(p99, 6) AS p99, (SELECT round(avg(e), 6) FROM errs) AS mean, "
                             "(SELECT round(stddev_pop(e), 6) FROM errs) AS std, (SELECT round(median(e), 6) FROM errs) AS median, "
                             "(SELECT round(quantile_cont(e, 0.75) - quantile_cont(e, 0.25), 6) FROM errs) AS iqr FROM sev", *W, SEV))
def learn_severity(spark, sf, ws):
    row = learned(spark, sf, ws)[1].to_row(spark)
    return rounded(row, *row.columns)


@query("severity_label", sql(f"SELECT {LABEL} AS severity, round(e, 6) AS e FROM errs, sev", *W, SEV))
def severity_label(spark, sf, ws):
    errors, model = learned(spark, sf, ws)
    return rounded(errors.select(severity(F.col("e"), model.thresholds).alias("severity"), "e"), "e")


@query("severity_confidence", sql(f"SELECT round({CONF}, 6) AS confidence, round(e, 6) AS e FROM errs, sev", *W, SEV))
def severity_confidence_query(spark, sf, ws):
    errors, model = learned(spark, sf, ws)
    return rounded(errors.select(severity_confidence(F.col("e"), model.thresholds).alias("confidence"), "e"), "confidence", "e")


# ---- anomalies ----------------------------------------------------------------------------------

RECORD = "anomaly_type, severity, round(confidence, 6) AS confidence, round(anomaly_score, 6) AS anomaly_score, processing_mode, timestamp"
LOG = "content, event_template, level, component, CAST(line_id AS STRING) AS line_id"


@query("single_log_anomalies", sql(f"SELECT {LOG}, {RECORD} FROM anom WHERE processing_mode = 'single_log'", *FULL))
def single_log_anomalies(spark, sf, ws):
    found = run(spark, sf, ws, "single").single
    return rounded(found.select("log.*", "anomaly_type", "severity", "confidence", "anomaly_score", "processing_mode", "timestamp"),
                   "confidence", "anomaly_score")


@query("sequential_anomalies", sql(f"SELECT win_id, contents, line_ids, dominant AS anomaly_type, {LABEL} AS severity, round({CONF}, 6) AS confidence, "
                                   "time AS timestamp, n_logs AS sequence_length, round(e, 6) AS anomaly_score, 'sequential' AS processing_mode, "
                                   "non_normal AS non_normal_count, n_logs AS total_logs_in_sequence FROM seq", *FULL[:-1]))
def sequential_anomalies(spark, sf, ws):
    found = run(spark, sf, ws, "sequential").sequential
    return rounded(found.select("win_id", F.array_join("logs.content", "|").alias("contents"), F.array_join("logs.line_id", "|").alias("line_ids"),
                                "anomaly_type", "severity", "confidence", "timestamp", "sequence_length", "anomaly_score", "processing_mode",
                                "non_normal_count", "total_logs_in_sequence"), "confidence", "anomaly_score")


@query("detect_modes", sql(f"SELECT {RECORD}, win_id, position FROM anom", *FULL))
def detect_modes(spark, sf, ws):
    found = run(spark, sf, ws).anomalies()
    return rounded(found.select("anomaly_type", "severity", "confidence", "anomaly_score", "processing_mode", "timestamp", "win_id", "position"),
                   "confidence", "anomaly_score")


HYBRID = [SEQ.replace("seqrows", "hybrows").replace("w.sequential_error AS e", "0.6::DOUBLE * w.sequential_error + 0.4::DOUBLE * w.single_error AS e")
          .replace("w.sequential_error > t_seq", "0.6::DOUBLE * w.sequential_error + 0.4::DOUBLE * w.single_error > t_hyb")]
HYBRID_THR = "thr AS (SELECT quantile_cont(0.6::DOUBLE * sequential_error + 0.4::DOUBLE * single_error, 0.95) AS t_hyb FROM wins)"


@query("hybrid_anomalies", sql(f"SELECT win_id, contents, dominant AS anomaly_type, {LABEL} AS severity, round({CONF}, 6) AS confidence, "
                               "round(e, 6) AS anomaly_score, 'hybrid' AS processing_mode, non_normal AS non_normal_count FROM seq", *W, HYBRID_THR, SEV, *HYBRID))
def hybrid_anomalies(spark, sf, ws):
    found = run(spark, sf, ws, "hybrid").anomalies()
    return rounded(found.select("win_id", F.array_join("logs.content", "|").alias("contents"), "anomaly_type", "severity", "confidence",
                                "anomaly_score", "processing_mode", "non_normal_count"), "confidence", "anomaly_score")


# Windows per host: the first row's place among all hosts' rows names a window.
KWINS = ("wins AS MATERIALIZED (SELECT level AS key, kidx // 8 AS w, min(place) AS win_id, (kidx // 8) * 8 AS start_idx, avg(sequential_error) AS sequential_error, "
         "avg(single_error) AS single_error FROM placed WHERE (kidx // 8) * 8 < kn - 8 GROUP BY ALL)")
KRWS = ("krws AS (SELECT p.* EXCLUDE (idx), kidx AS idx, w.win_id, w.start_idx, w.sequential_error AS w_seq, w.single_error AS w_single FROM placed p "
        "JOIN wins w ON w.key = p.level AND w.w = p.kidx // 8)")
KSINGLE = SINGLE.replace("r.*, w.win_id, w.single_error AS e", "r.*, w_single AS e").replace(
    "FROM rws r JOIN wins w ON r.idx // 8 = w.win_id, thr, sev WHERE w.single_error", "FROM krws r, thr, sev WHERE w_single")
KSEQ = SEQ.replace("r.*, w.win_id, w.start_idx, w.sequential_error AS e, r.idx - w.start_idx AS off", "r.*, w_seq AS e, r.idx - r.start_idx AS off").replace(
    "FROM rws r JOIN wins w ON r.idx // 8 = w.win_id, thr WHERE w.sequential_error", "FROM krws r, thr WHERE w_seq")


@query("detect_modes_by_key", sql(f"SELECT level AS host, {RECORD}, win_id, position FROM anom", *BASE, KEYED, KWINS, KRWS, THR, SEV, KSINGLE, KSEQ, ANOM))
def detect_modes_by_key(spark, sf, ws):
    """Both modes over windows that hold lines of one host only."""
    placed = place_rows(scored(spark, sf, ws)[0].drop("idx"), ["line_id"], ws, "level")
    found = dt.detect(placed.rows, placed.n, ws, key="level").anomalies()
    return rounded(found.select(F.col("level").alias("host"), "anomaly_type", "severity", "confidence", "anomaly_score", "processing_mode",
                                "timestamp", "win_id", "position"), "confidence", "anomaly_score")


@query("union_modes", sql("SELECT processing_mode, anomaly_type, position, CASE WHEN processing_mode = 'sequential' THEN 8 END AS sequence_length FROM anom", *FULL))
def union_modes(spark, sf, ws):
    found = run(spark, sf, ws)
    return dt.union_modes(found.single, found.sequential).select("processing_mode", "anomaly_type", "position", "sequence_length")


@query("run_summary", sql("SELECT (SELECT count(*) FROM rws) AS total_logs, 'both' AS mode, (SELECT count(*) FROM seq) AS sequential_count, "
                          "(SELECT count(*) FROM single) AS single_log_count, CAST(0 AS BIGINT) AS hybrid_count, round(t_seq, 6) AS sequential_threshold, "
                          "round(t_single, 6) AS single_log_threshold, CAST(NULL AS DOUBLE) AS hybrid_threshold FROM thr", *FULL))
def run_summary(spark, sf, ws):
    return rounded(run(spark, sf, ws).summary(), *LIMITS)


@query("run_summary_hybrid", sql("SELECT (SELECT count(*) FROM rws) AS total_logs, 'hybrid' AS mode, CAST(0 AS BIGINT) AS sequential_count, "
                                 "CAST(0 AS BIGINT) AS single_log_count, (SELECT count(*) FROM seq) AS hybrid_count, CAST(NULL AS DOUBLE) AS sequential_threshold, "
                                 "CAST(NULL AS DOUBLE) AS single_log_threshold, round(t_hyb, 6) AS hybrid_threshold FROM thr", *W, HYBRID_THR, SEV, *HYBRID))
def run_summary_hybrid(spark, sf, ws):
    """What a run in mode ``hybrid`` reports, read back from the written report."""
    from ..sources.sinks import write_reports
    folder, found = ws.path("reports"), run(spark, sf, ws, "hybrid")
    write_reports(found, folder)
    summary = spark.read.schema(found.summary().schema).json(f"{folder}/run")
    records = spark.read.schema(found.hybrid.schema).json(f"{folder}/hybrid_anomalies").agg(F.count(F.lit(1)).alias("hybrid_count"))
    return rounded(summary.drop("hybrid_count").crossJoin(F.broadcast(records)), *LIMITS)


@query("export_shape", sql(f"SELECT {LOG}, {RECORD} FROM anom", *FULL))
def export_shape(spark, sf, ws):
    records = dt.export_records(anomalies(spark, sf))
    return rounded(records.select("log.*", "anomaly_type", "severity", "confidence", "anomaly_score", "processing_mode", "timestamp"),
                   "confidence", "anomaly_score")


@query("mode_overlap", sql(
    "SELECT count(CASE WHEN s.line_id IS NOT NULL AND q.line_id IS NOT NULL THEN 1 END) AS both, count(CASE WHEN q.line_id IS NULL THEN 1 END) AS single_only, "
    "count(CASE WHEN s.line_id IS NULL THEN 1 END) AS sequential_only, count(CASE WHEN q.r > s.r THEN 1 END) AS escalated, "
    "count(CASE WHEN q.r < s.r THEN 1 END) AS reduced, count(CASE WHEN q.r = s.r THEN 1 END) AS consistent FROM "
    "(SELECT line_id, list_position(['Low', 'Medium', 'High', 'Critical'], severity) AS r FROM anom WHERE processing_mode = 'single_log') s FULL JOIN "
    "(SELECT r.line_id, list_position(['Low', 'Medium', 'High', 'Critical'], a.severity) AS r FROM anom a JOIN rws r ON r.idx // 8 = a.win_id WHERE processing_mode = 'sequential') q "
    "ON s.line_id = q.line_id", *FULL))
def mode_overlap(spark, sf, ws):
    return an.mode_overlap(anomalies(spark, sf))


@query("threat_level", sql("SELECT count(CASE WHEN severity = 'Critical' THEN 1 END) AS critical, count(CASE WHEN severity = 'High' THEN 1 END) AS high, "
                           "CASE WHEN count(CASE WHEN severity = 'Critical' THEN 1 END) > 0 THEN 'CRITICAL' WHEN count(CASE WHEN severity = 'High' THEN 1 END) > 5 THEN 'HIGH' ELSE 'NORMAL' END AS threat_level FROM anom", *FULL))
def threat_level(spark, sf, ws):
    return dt.threat_level(anomalies(spark, sf))


def _alert(rule, value, limit):
    return f"SELECT '{rule}' AS rule, round(CAST({value} AS DOUBLE), 6) AS value, {limit}::DOUBLE AS \"limit\", {value} >= {limit} AS fired FROM anom"


@query("alert_rules", sql(" UNION ALL ".join([
    _alert("critical", "count(CASE WHEN severity = 'Critical' THEN 1 END)", 1), _alert("high", "count(CASE WHEN severity = 'High' THEN 1 END)", 5),
    _alert("rate", "(count(*) * 100.0 / (SELECT count(*) FROM logs))", 10), _alert("sequential", "count(CASE WHEN processing_mode = 'sequential' THEN 1 END)", 3),
    _alert("single_log", "count(CASE WHEN processing_mode = 'single_log' THEN 1 END)", 10), _alert("hybrid", "count(CASE WHEN processing_mode = 'hybrid' THEN 1 END)", 5)]), *FULL))
def alert_rules(spark, sf, ws):
    found, outcome = stored(spark, sf)
    return rounded(dt.alerts(found, outcome.total_logs), "value")


# Three quantile detectors over the events: their highest 5 % of one measure each.
VOTES = ("cut AS (SELECT quantile_cont(value, 0.95) AS a, quantile_cont(abs(value - 50), 0.95) AS b, quantile_cont(CAST(length(content) AS DOUBLE), 0.95) AS c FROM logs), "
         "votes AS (SELECT line_id, CASE WHEN value > a THEN -1 ELSE 1 END AS by_value, CASE WHEN abs(value - 50) > b THEN -1 ELSE 1 END AS by_distance, "
         "CASE WHEN length(content) > c THEN -1 ELSE 1 END AS by_length FROM logs, cut)")


def votes(spark, sf, ws):
    rows = logs(spark, sf)
    measures = {"by_value": F.col("value"), "by_distance": F.abs(F.col("value") - 50), "by_length": F.length("content").cast("double")}
    rows = ws.stage(rows.select("line_id", *[m.alias(n) for n, m in measures.items()]), "measures")
    limits = {n: dt.flag_threshold(rows, n, ws) for n in measures}
    return rows.select("line_id", *[F.when(F.col(n) > limits[n], -1).otherwise(1).alias(n) for n in measures])


@query("consensus_votes", sql("SELECT * FROM (SELECT *, CAST(by_value = -1 AS INT) + CAST(by_distance = -1 AS INT) + CAST(by_length = -1 AS INT) AS anomaly_votes "
                              "FROM votes) WHERE anomaly_votes >= 2", VOTES))
def consensus_votes(spark, sf, ws):
    return dt.consensus(votes(spark, sf, ws), ["by_value", "by_distance", "by_length"])


@query("anomaly_count", sql("SELECT count(CASE WHEN by_value = -1 THEN 1 END) AS anomalies, count(*) AS total FROM votes", VOTES))
def anomaly_count(spark, sf, ws):
    return dt.count_flagged(votes(spark, sf, ws), "by_value")


# ---- analytics ----------------------------------------------------------------------------------

@query("severity_distribution", sql("SELECT processing_mode, severity, count(*) AS n FROM anom GROUP BY ALL", *FULL))
def severity_distribution(spark, sf, ws):
    return an.severity_distribution(anomalies(spark, sf))


_STATS = ["mean", "std", "min", "max", "median", "p25", "p75", "p90", "p95", "p99"]
_STATS_SQL = ("avg({c}) AS mean, stddev_pop({c}) AS std, min({c}) AS min, max({c}) AS max, median({c}) AS median, quantile_cont({c}, 0.25) AS p25, "
              "quantile_cont({c}, 0.75) AS p75, quantile_cont({c}, 0.9) AS p90, quantile_cont({c}, 0.95) AS p95, quantile_cont({c}, 0.99) AS p99")


@query("score_statistics", sql("SELECT m.processing_mode, coalesce(n, 0) AS n, " + ", ".join(f"round(coalesce({s}, 0), 6) AS {s}" for s in _STATS) +
                               " FROM (SELECT unnest(['single_log', 'sequential']) AS processing_mode) m LEFT JOIN (SELECT processing_mode, count(*) AS n, " +
                               _STATS_SQL.format(c="anomaly_score") + " FROM anom GROUP BY ALL) s USING (processing_mode)", *FULL))
def score_statistics(spark, sf, ws):
    return rounded(an.score_statistics(anomalies(spark, sf), ws), *_STATS)


@query("threshold_effectiveness", sql("SELECT p AS percentile, round(t, 6) AS threshold, (SELECT count(*) FROM anom WHERE anomaly_score > t) AS detected, "
                                      "round((SELECT count(*) FROM anom WHERE anomaly_score > t) / (SELECT count(*) FROM anom)::DOUBLE, 6) AS rate FROM (" +
                                      " UNION ALL ".join(f"SELECT {p} AS p, quantile_cont(anomaly_score, {p / 100}) AS t FROM anom" for p in (80, 85, 90, 95, 97, 99)) + ") x", *FULL))
def threshold_effectiveness(spark, sf, ws):
    return rounded(an.threshold_effectiveness(anomalies(spark, sf), ws), "threshold", "rate")


@query("severity_transitions", sql("SELECT severity, single_count, sequential_count, sequential_count - single_count AS difference FROM (SELECT d.severity, "
                                   "count(CASE WHEN processing_mode = 'single_log' THEN 1 END) AS single_count, count(CASE WHEN processing_mode = 'sequential' THEN 1 END) AS sequential_count "
                                   "FROM (SELECT unnest(['Low', 'Medium', 'High', 'Critical']) AS severity) d LEFT JOIN anom USING (severity) GROUP BY ALL) x", *FULL))
def severity_transitions(spark, sf, ws):
    return an.severity_transitions(anomalies(spark, sf))


def _confidence(key):
    return sql(f"SELECT {key}, round(avg(confidence), 6) AS mean, round(stddev_pop(confidence), 6) AS std, round(min(confidence), 6) AS min, "
               f"round(max(confidence), 6) AS max, count(*) AS n, round(median(confidence), 6) AS median FROM anom GROUP BY ALL", *FULL)


@query("confidence_by_severity", _confidence("severity"))
def confidence_by_severity(spark, sf, ws):
    return rounded(an.confidence_by(anomalies(spark, sf), "severity", ws), "mean", "std", "min", "max", "median")


@query("confidence_by_type", _confidence("anomaly_type"))
def confidence_by_type(spark, sf, ws):
    return rounded(an.confidence_by(anomalies(spark, sf), "anomaly_type", ws), "mean", "std", "min", "max", "median")


@query("type_distribution", sql("SELECT anomaly_type, count(CASE WHEN processing_mode = 'single_log' THEN 1 END) AS single, "
                                "count(CASE WHEN processing_mode = 'sequential' THEN 1 END) AS sequential, count(*) AS combined FROM anom GROUP BY ALL", *FULL))
def type_distribution(spark, sf, ws):
    return an.type_distribution(anomalies(spark, sf))


RULES_DIM = "dim AS (" + " UNION ALL ".join(f"SELECT {quoted(c)} AS category, {len(p)} AS pattern_count, {WEIGHTS[c]}::DOUBLE AS weight" for c, p in RULES.items()) + ")"


@query("pattern_effectiveness", sql("SELECT category, pattern_count, weight, count(CASE WHEN processing_mode = 'single_log' THEN 1 END) AS single_detections, "
                                    "count(CASE WHEN processing_mode = 'sequential' THEN 1 END) AS sequential_detections FROM dim LEFT JOIN anom ON anomaly_type = category GROUP BY ALL",
                                    *FULL, RULES_DIM))
def pattern_effectiveness(spark, sf, ws):
    return an.pattern_effectiveness(anomalies(spark, sf))


@query("join_rules_dim", sql("SELECT category, count(log_type) AS n FROM dim LEFT JOIN verdict ON log_type = category GROUP BY ALL", *FULL[:2], RULES_DIM))
def join_rules_dim(spark, sf, ws):
    """Every rule category with the logs it decides, zero when none."""
    hits = with_log_type(templated(spark, sf), "category").groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    dim = spark.createDataFrame([(c,) for c in RULES], "category string")
    return F.broadcast(dim).join(hits, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


@query("type_severity_matrix", sql("SELECT anomaly_type, severity, round(count(*) / sum(count(*)) OVER (PARTITION BY anomaly_type), 6) AS share FROM anom GROUP BY anomaly_type, severity", *FULL))
def type_severity_matrix(spark, sf, ws):
    return rounded(an.type_severity_matrix(anomalies(spark, sf)), "share")


@query("high_critical_share", sql("SELECT anomaly_type, round(avg(CASE WHEN severity IN ('High', 'Critical') THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS high_critical_pct FROM anom GROUP BY ALL", *FULL))
def high_critical_share(spark, sf, ws):
    return rounded(an.high_critical_share(anomalies(spark, sf)), "high_critical_pct")


METRICS = ("SELECT c AS class, round(coalesce(tp / nullif(predicted, 0), 0), 6) AS precision, round(coalesce(tp / nullif(support, 0), 0), 6) AS recall, support, "
           "round(coalesce(2 * (tp / nullif(predicted, 0)) * (tp / nullif(support, 0)) / nullif((tp / nullif(predicted, 0)) + (tp / nullif(support, 0)), 0), 0), 6) AS f1 FROM "
           "(SELECT c, sum(CASE WHEN t = c AND p = c THEN 1 ELSE 0 END)::DOUBLE AS tp, CAST(sum(CASE WHEN t = c THEN 1 ELSE 0 END) AS BIGINT) AS support, "
           "sum(CASE WHEN p = c THEN 1 ELSE 0 END)::DOUBLE AS predicted FROM pairs, (SELECT t AS c FROM pairs UNION SELECT p FROM pairs) cls GROUP BY c) m")


@query("classification_metrics", "WITH pairs AS (SELECT quality AS t, toxic AS p FROM labels) " + METRICS)
def classification_metrics(spark, sf, ws):
    return rounded(an.classification_metrics(table(spark, sf, "labels"), "quality", "toxic"), "precision", "recall", "f1")


# What each branch of the view should be called.
TRUTH = ("CASE branch WHEN 'B0' THEN 'authentication_error' WHEN 'B1' THEN 'authentication_error' WHEN 'B2' THEN 'memory_error' WHEN 'B3' THEN 'network_error' "
         "WHEN 'B4' THEN 'filesystem_error' WHEN 'B5' THEN 'memory_error' ELSE 'normal' END")


@query("classification_metrics_rules", sql(METRICS, LABELED_CTE, VERDICT_CTE, f"pairs AS (SELECT {TRUTH} AS t, log_type AS p FROM verdict)"))
def classification_metrics_rules(spark, sf, ws):
    rows = with_log_type(templated(spark, sf), "predicted").select(F.expr(TRUTH).alias("truth"), "predicted")
    return rounded(an.classification_metrics(rows, "truth", "predicted"), "precision", "recall", "f1")


@query("score_stability", sql("SELECT round(var_pop(confidence), 6) AS confidence_variance, round(stddev_pop(anomaly_score), 6) AS score_std FROM anom", *FULL))
def score_stability(spark, sf, ws):
    return rounded(an.score_stability(anomalies(spark, sf)), "confidence_variance", "score_std")


@query("top_types", sql("SELECT anomaly_type, count(*) AS n FROM anom GROUP BY ALL ORDER BY n DESC, anomaly_type LIMIT 5", *FULL))
def top_types(spark, sf, ws):
    return an.top_types(anomalies(spark, sf))


@query("severity_summary", sql("SELECT " + ", ".join(f"count(CASE WHEN processing_mode = '{m}' AND severity = '{s}' THEN 1 END) AS {m}_{s.lower()}" for m in an.MODES for s in SEVERITY_LABELS) +
                               ", " + ", ".join(f"round(avg(CASE WHEN processing_mode = '{m}' THEN anomaly_score END), 6) AS {m}_mean" for m in an.MODES) +
                               ", round(stddev_pop(anomaly_score), 6) AS combined_std, (SELECT round(p85, 6) FROM sev) AS p85, (SELECT round(p95, 6) FROM sev) AS p95, "
                               "(SELECT round(p99, 6) FROM sev) AS p99 FROM anom", *FULL))
def severity_summary(spark, sf, ws):
    found, outcome = stored(spark, sf)
    limits = {f"p{p}": v for p, v in zip(outcome.severity.percentiles, outcome.severity.thresholds)}
    return rounded(an.severity_summary(found, limits), "single_log_mean", "sequential_mean", "combined_std", "p85", "p95", "p99")


@query("mode_error_summary", sql("SELECT 'sequential' AS processing_mode, (SELECT count(*) FROM seq) AS total_anomalies, round(avg(sequential_error), 6) AS mean_error, round(any_value(t_seq), 6) AS threshold FROM wins, thr "
                                 "UNION ALL SELECT 'single_log', (SELECT count(*) FROM single), round(avg(single_error), 6), round(any_value(t_single), 6) FROM wins, thr", *FULL))
def mode_error_summary(spark, sf, ws):
    found, outcome = stored(spark, sf)
    return rounded(an.mode_error_summary(found, outcome.errors, outcome.thresholds, ERRORS), "mean_error", "threshold")


@query("hourly_profile", sql("SELECT hour(ts) AS hour, count(*) AS n, count(CASE WHEN dayofweek(ts) IN (0, 6) THEN 1 END) AS weekend, "
                             "count(CASE WHEN dayofweek(ts) NOT IN (0, 6) THEN 1 END) AS weekday FROM anom GROUP BY ALL", *FULL))
def hourly_profile(spark, sf, ws):
    """Anomalies of both modes; a sequence counts at the earliest time of its logs."""
    lines = F.when(F.col("log").isNotNull(), F.array("log.line_id")).otherwise(F.col("logs.line_id"))
    rows = anomalies(spark, sf).select("seq", F.explode(lines.cast("array<bigint>")).alias("line_id"))
    timed = rows.join(logs(spark, sf).select("line_id", "ts"), "line_id").groupBy("seq").agg(F.min("ts").alias("ts"))
    return an.hourly_profile(timed)


# ---- dashboard ----------------------------------------------------------------------------------

IS_THREAT = "anomaly_type IN (" + ", ".join(map(quoted, THREAT_TYPES)) + ")"
ENTRY = ["seq", "anomaly_type", "severity", "confidence", "anomaly_score", "processing_mode", "timestamp"]
ENTRY_SQL = f"seq, {RECORD}"


def entries(df):
    return rounded(df.select(*ENTRY), "confidence", "anomaly_score")


@query("latest_logs", sql(f"SELECT {ENTRY_SQL} FROM store ORDER BY seq DESC LIMIT 100", *FULL, STORE))
def latest_logs(spark, sf, ws):
    return entries(db.latest_logs(anomalies(spark, sf), "seq"))


@query("recent_logs", sql(f"SELECT {ENTRY_SQL} FROM store ORDER BY seq DESC LIMIT 5", *FULL, STORE))
def recent_logs(spark, sf, ws):
    return entries(db.latest_logs(anomalies(spark, sf), "seq", 5))


@query("recent_threats", sql(f"SELECT {ENTRY_SQL} FROM store WHERE {IS_THREAT} ORDER BY seq DESC LIMIT 5", *FULL, STORE))
def recent_threats(spark, sf, ws):
    return entries(db.recent_threats(anomalies(spark, sf), "seq"))


# All logs with their rule type are the widest table of threats and non-threats.
def typed_logs(spark, sf):
    return with_log_type(templated(spark, sf), "anomaly_type").select("line_id", "anomaly_type")


@query("threat_share", sql("SELECT count(CASE WHEN log_type <> 'normal' THEN 1 END) AS threats, count(CASE WHEN log_type = 'normal' THEN 1 END) AS non_threats, "
                           "round(100.0::DOUBLE * count(CASE WHEN log_type <> 'normal' THEN 1 END) / count(*), 1) AS threat_pct FROM verdict", *FULL[:2]))
def threat_share(spark, sf, ws):
    return db.threat_share(typed_logs(spark, sf))


@query("threat_type_counts", sql("SELECT log_type AS anomaly_type, count(*) AS n FROM verdict WHERE log_type <> 'normal' GROUP BY ALL", *FULL[:2]))
def threat_type_counts(spark, sf, ws):
    return db.threat_type_counts(typed_logs(spark, sf))


@query("threat_timeline", sql("SELECT line_id, log, threat, CAST(sum(threat) OVER (ORDER BY line_id) AS BIGINT) AS threats_so_far FROM (SELECT line_id, 1 AS log, "
                              "CASE WHEN log_type <> 'normal' THEN 1 ELSE 0 END AS threat FROM verdict ORDER BY line_id DESC LIMIT 10) t", *FULL[:2]))
def threat_timeline(spark, sf, ws):
    return db.threat_timeline(typed_logs(spark, sf), "line_id").select("line_id", "log", "threat", "threats_so_far")


@query("top_anomalies", sql("SELECT processing_mode, rank, anomaly_type, severity, round(anomaly_score, 6) AS anomaly_score, substr(content, 1, 60) AS content, "
                            "array_to_string(list_transform(string_split(contents, '|')[1:3], lambda c: substr(c, 1, 60)), '|') AS first_contents FROM "
                            "(SELECT *, row_number() OVER (PARTITION BY processing_mode ORDER BY position) AS rank FROM anom) WHERE rank <= 3", *FULL))
def top_anomalies(spark, sf, ws):
    store = anomalies(spark, sf).withColumn("contents", F.coalesce("logs.content", F.array("log.content")))
    top = db.top_anomalies(store, "position")
    return rounded(top.select("processing_mode", "rank", "anomaly_type", "severity", "anomaly_score", "content",
                              F.array_join("first_contents", "|").alias("first_contents")), "anomaly_score")


RAW_TIME = "CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN right(stamp, 8) WHEN 2 THEN '2024-01-02T' || right(stamp, 8) ELSE 'not a time at all' END"


@query("normalize_timestamp", sql("SELECT line_id, CASE WHEN raw = '' THEN 'No timestamp' WHEN length(raw) < 10 THEN '2024-02-01 ' || raw "
                                  "ELSE coalesce(strftime(try_cast(raw AS TIMESTAMP), '%Y-%m-%d %H:%M:%S'), raw) END AS shown FROM "
                                  f"(SELECT line_id, {RAW_TIME} AS raw FROM logs) t"))
def normalize_timestamp(spark, sf, ws):
    raw = logs(spark, sf).select("line_id", F.expr(RAW_TIME).alias("raw"))
    return raw.select("line_id", db.normalize_timestamp(F.col("raw"), "2024-02-01").alias("shown"))
