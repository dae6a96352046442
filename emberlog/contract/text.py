"""Queries and oracles of parsing, collecting and rule classification."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import functions as F

from ..functions import syslog, text
from ..operators import collect, parsing
from ..operators.classify import classify, with_log_type
from ..operators.indexing import index_rows
from ..plans.presets import PRESETS
from ..plans.rulebook import (AUTH_LINE, CONTENT_FLAGS, CRITICAL_TYPES, KERNEL_LINE, RULES, SYSLOG_LINE,
                              THREAT_TYPES, WEIGHTS)
from .base import logs, query, quoted, sql
from .mining import LINUX

LINUX_RE = quoted(text.compile_format(LINUX.log_format, atomic=False)[0])
PARSED_CTE = (f"parsed AS (SELECT line_id, regexp_extract(line, {LINUX_RE}, 1) AS month, regexp_extract(line, {LINUX_RE}, 2) AS date, "
              f"regexp_extract(line, {LINUX_RE}, 3) AS time, regexp_extract(line, {LINUX_RE}, 4) AS level, "
              f"regexp_extract(line, {LINUX_RE}, 5) AS component, nullif(regexp_extract(line, {LINUX_RE}, 7), '') AS pid, "
              f"regexp_extract(line, {LINUX_RE}, 8) AS content FROM logs WHERE regexp_matches(line, {LINUX_RE}))")


@query("parse_log_format", sql("SELECT * FROM parsed", PARSED_CTE))
def parse_log_format(spark, sf, ws):
    return parsing.parse_logs(logs(spark, sf), LINUX.log_format, "line", keep=["line_id"])


# Lines that lose their separator fit no layout.
BROKEN = "CASE WHEN k % 9 = 0 THEN replace(line, ': ', ' ') ELSE line END"
BROKEN_CTE = f"broken AS (SELECT line_id, {BROKEN} AS line FROM logs)"


def broken(spark, sf):
    return logs(spark, sf).select("line_id", F.expr(BROKEN).alias("line"))


@query("parse_rejects", sql(f"SELECT line_id, line FROM broken WHERE NOT regexp_matches(line, {LINUX_RE})", BROKEN_CTE))
def parse_rejects(spark, sf, ws):
    return parsing.parse_logs(broken(spark, sf), LINUX.log_format, "line", rejects=True)


@query("line_index", sql("SELECT line_id AS source_id, row_number() OVER (ORDER BY line_id) AS line_id FROM broken "
                         f"WHERE regexp_matches(line, {LINUX_RE})", BROKEN_CTE))
def line_index(spark, sf, ws):
    """1-based numbers of the lines that fit, without a single-task sort."""
    matched = parsing.parse_logs(broken(spark, sf), LINUX.log_format, "line", keep=["line_id"]).select("line_id")
    return index_rows(matched, ["line_id"], ws).select(F.col("line_id").alias("source_id"), (F.col("idx") + 1).alias("line_id"))


# Lines of the view re-written in other layouts; {date} and {time} come from the time stamp.
LAYOUTS = {
    "Linux": "line",
    "Spark": "'24/01/01 ' || right(stamp, 8) || ' INFO ' || component || ': ' || content",
    "HDFS": "'240101 ' || replace(right(stamp, 8), ':', '') || ' ' || CAST(pid AS STRING) || ' INFO ' || component || ': blk_-' || CAST(line_id AS STRING) || ' ' || content",
    "Apache": "'[' || stamp || '] [notice] ' || content",
    "Proxifier": "'[01.01 ' || right(stamp, 8) || '] ' || component || '.exe - ' || content",
    "Hadoop": "'2024-01-01 ' || right(stamp, 8) || ',001 INFO [main] ' || component || ': ' || content",
    "Zookeeper": "'2024-01-01 ' || right(stamp, 8) || ' - INFO  [' || host || ':' || component || '@' || CAST(pid AS STRING) || '] - ' || content",
    "BGL": "'- 1117838570 2024.01.01 R02 2024-01-01-' || right(stamp, 8) || ' R02 RAS ' || component || ' INFO ' || content",
    "HPC": "CAST(line_id AS STRING) || ' node-1 ' || component || ' state 1084680778 1 ' || content",
    "Thunderbird": "'- 1131566461 2024.01.01 ' || host || ' Jan 1 ' || right(stamp, 8) || ' ' || host || '/' || host || ' ' || component || '[' || CAST(pid AS STRING) || ']: ' || content",
    "Windows": "'2024-01-01 ' || right(stamp, 8) || ', Info                  ' || component || '    ' || content",
    "Android": "'01-01 ' || right(stamp, 8) || '.001  1702  2395 D ' || component || ': ' || content",
    "HealthApp": "'20240101-' || right(stamp, 8) || '|' || component || '|' || CAST(pid AS STRING) || '|' || content",
    "OpenSSH": "'Jan 1 ' || right(stamp, 8) || ' ' || component || ' sshd[' || CAST(pid AS STRING) || ']: ' || content",
    "OpenStack": "'nova.log.1 2024-01-01 ' || right(stamp, 8) || ' 2931 INFO ' || component || ' [req-1] ' || content",
    "Mac": "'Jul  1 ' || right(stamp, 8) || ' ' || host || ' ' || component || '[' || CAST(pid AS STRING) || ']: ' || content",
}


def _only_group(pattern, number):
    """The pattern with one group left to capture: DuckDB numbers no more than nine."""
    groups = itertools.count(1)
    keep = lambda m: m[0] if m[0] != "(" or next(groups) == number else "(?:"
    return re.sub(r"\\.|\((?!\?)", keep, pattern)


def _preset_sql(name):
    from .mining import norm_sql
    pattern, headers = text.compile_format(PRESETS[name].log_format, atomic=False)
    pattern = _only_group(pattern, headers["Content"][0])
    content = f"regexp_extract({LAYOUTS[name]}, {quoted(pattern)}, 1)"
    return (f"SELECT {quoted(name)} AS preset, line_id, content, {norm_sql(PRESETS[name])} AS normalized FROM "
            f"(SELECT line_id, {content} AS content FROM logs WHERE regexp_matches({LAYOUTS[name]}, {quoted(pattern)})) t")


@query("format_presets", sql(" UNION ALL ".join(_preset_sql(n) for n in LAYOUTS)))
def format_presets(spark, sf, ws):
    base, out = logs(spark, sf), None
    for name, layout in LAYOUTS.items():
        lines = base.select("line_id", F.expr(layout).alias("value"))
        rows = parsing.parse_preset(lines, name, keep=["line_id"]).select(
            F.lit(name).alias("preset"), "line_id", "content",
            text.normalized(F.col("content"), PRESETS[name]).alias("normalized"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _masked_sql(col):
    for pattern in LINUX.masks:
        col = f"regexp_replace({col}, {quoted(pattern)}, '<*>', 'g')"
    return col


@query("mask_tokens", sql(f"SELECT line_id, {_masked_sql('line')} AS masked FROM logs"))
def mask_tokens(spark, sf, ws):
    return logs(spark, sf).select("line_id", text.mask(F.col("line"), LINUX.masks).alias("masked"))


@query("strip_delimiters", sql("SELECT line_id, regexp_replace(content, '\\(.*?\\)', '', 'g') AS stripped FROM logs"))
def strip_delimiters(spark, sf, ws):
    return logs(spark, sf).select("line_id", text.delete(F.col("content"), PRESETS["Proxifier"].deletions).alias("stripped"))


SPACED = ["HealthApp", "Android", "HPC", "BGL", "Hadoop", "HDFS", "Linux", "Spark", "Thunderbird", "Windows", "Zookeeper"]


def _spaced_sql(name):
    col = "line"
    for mark in PRESETS[name].separators:
        col = f"replace({col}, {quoted(mark)}, {quoted(mark + ' ')})"
    return f"{col} AS {name.lower()}"


@query("space_separators", sql("SELECT line_id, " + ", ".join(map(_spaced_sql, SPACED)) + " FROM logs"))
def space_separators(spark, sf, ws):
    return logs(spark, sf).select("line_id", *[text.space_out(F.col("line"), PRESETS[n].separators).alias(n.lower())
                                              for n in SPACED])


@query("tokenize", sql("SELECT line_id, array_to_string(t, '|') AS tokens, CAST(len(t) AS BIGINT) AS n_tokens FROM (SELECT line_id, "
                       "string_split(regexp_replace(replace(content, ',', ', '), ' +', ' ', 'g'), ' ') AS t FROM logs) x"))
def tokenize(spark, sf, ws):
    tokens = text.words(text.single_spaced(F.col("content")))
    return logs(spark, sf).select("line_id", F.array_join(tokens, "|").alias("tokens"), F.size(tokens).cast("long").alias("n_tokens"))


# ---- collected payloads -------------------------------------------------------------------------

# Every line as one of nine kinds of payload.
PAYLOAD = """CASE k % 9
 WHEN 0 THEN '{"message": "' || line || '", "log": {"file": {"path": "/var/log/auth.log"}}, "host": {"hostname": "' || host || '"}, "@timestamp": "' || stamp || '"}'
 WHEN 1 THEN '{"message": "' || content || '"}'
 WHEN 2 THEN '{"message": "Filebeat: ' || content || '", "host": {"hostname": "' || host || '"}}'
 WHEN 3 THEN '{"message": "  ", "host": {"hostname": "' || host || '"}}'
 WHEN 4 THEN '{"message": "' || line || '"'
 WHEN 5 THEN content
 WHEN 6 THEN stamp || ' ' || host || ' filebeat[' || CAST(pid AS STRING) || ']: ' || content
 WHEN 7 THEN stamp || ' ' || host || ' ' || component || '.service: ' || content
 ELSE line END"""
PAYLOAD_CTE = f"payloads AS (SELECT line_id, {PAYLOAD} AS value FROM logs)"


def payloads(spark, sf):
    return logs(spark, sf).select("line_id", F.expr(PAYLOAD).alias("value"))


def _x(pattern, n):
    return f"regexp_extract(message, {quoted('^' + pattern)}, {n})"


def _m(pattern):
    return f"regexp_matches(message, {quoted('^' + pattern)})"


JSON_CTE = ("bodies AS (SELECT line_id, value, json_valid(value) AND starts_with(value, '{') AS is_json FROM payloads), "
            "env AS (SELECT line_id, value, is_json, CASE WHEN is_json THEN coalesce(json_extract_string(value, '$.message'), '') ELSE value END AS message, "
            "CASE WHEN is_json THEN coalesce(json_extract_string(value, '$.log.file.path'), 'unknown') END AS path, "
            "CASE WHEN is_json THEN coalesce(json_extract_string(value, '$.host.hostname'), 'unknown') END AS hostname, "
            "CASE WHEN is_json THEN coalesce(json_extract_string(value, '$.\"@timestamp\"'), 'unknown') END AS ts FROM bodies)")
SYS_CTE = ("sys AS (SELECT e.*, " + _m(AUTH_LINE) + " AS a, " + _m(SYSLOG_LINE) + " AS s, " + _m(KERNEL_LINE) + " AS q FROM env e), "
           "fields AS (SELECT *, CASE "
           f"WHEN a THEN {_x(AUTH_LINE, 1)} WHEN s THEN {_x(SYSLOG_LINE, 1)} WHEN q THEN {_x(KERNEL_LINE, 1)} END AS f_timestamp, CASE "
           f"WHEN a THEN {_x(AUTH_LINE, 2)} WHEN s THEN {_x(SYSLOG_LINE, 2)} WHEN q THEN {_x(KERNEL_LINE, 2)} END AS f_hostname, "
           f"CASE WHEN a THEN {_x(AUTH_LINE, 3)} END AS f_process, CASE WHEN a THEN NULL WHEN s THEN {_x(SYSLOG_LINE, 3)} END AS f_program, "
           f"nullif(CASE WHEN a THEN {_x(AUTH_LINE, 5)} WHEN s THEN {_x(SYSLOG_LINE, 4)} END, '') AS f_pid, "
           f"CASE WHEN a OR s THEN NULL WHEN q THEN {_x(KERNEL_LINE, 3)} END AS f_uptime, CASE "
           f"WHEN a THEN {_x(AUTH_LINE, 6)} WHEN s THEN {_x(SYSLOG_LINE, 5)} WHEN q THEN {_x(KERNEL_LINE, 4)} END AS f_message, "
           "a OR s OR q AS fits FROM sys)")
FORMATTED = ("f_timestamp || ' ' || f_hostname || ' ' || coalesce(f_program, f_process, 'unknown') || "
             "coalesce('[' || f_pid || ']', '') || ': ' || f_message")
ROUTE_CTE = ("routed AS (SELECT *, CASE WHEN value IS NULL THEN 'invalid' "
             "WHEN (is_json AND (contains(lower(message), 'filebeat') OR contains(lower(message), 'monitoring'))) "
             "OR coalesce(f_program, f_process, '') = 'filebeat' THEN 'noise' WHEN fits THEN 'formatted' "
             "WHEN NOT is_json THEN 'unrecognized' WHEN trim(message) = '' THEN 'empty' ELSE 'short' END AS route FROM fields)")
COLLECT = [PAYLOAD_CTE, JSON_CTE, SYS_CTE, ROUTE_CTE]
OUTPUT = (f"CASE route WHEN 'formatted' THEN {FORMATTED} WHEN 'short' THEN ts || ' ' || hostname || ' ' || path || ': ' || trim(message) "
          "WHEN 'unrecognized' THEN value END")


@query("parse_syslog_multi", sql("SELECT line_id, f_timestamp AS timestamp, f_hostname AS hostname, f_process AS process, f_program AS program, "
                                 "f_pid AS pid, f_uptime AS uptime, f_message AS message FROM fields WHERE fits", *COLLECT[:3]))
def parse_syslog_multi(spark, sf, ws):
    parsed = collect.parse_payloads(payloads(spark, sf)).filter("parsed is not null")
    return parsed.select("line_id", "parsed.*")


@query("parse_json_envelope", sql("SELECT line_id, message, path, hostname, ts AS timestamp FROM env WHERE is_json", *COLLECT[:2]))
def parse_json_envelope(spark, sf, ws):
    return collect.classify_payload(payloads(spark, sf)).filter("is_json").select("line_id", "body.*")


@query("json_or_raw", sql("SELECT line_id, is_json, message FROM env", *COLLECT[:2]))
def json_or_raw(spark, sf, ws):
    return collect.classify_payload(payloads(spark, sf)).select("line_id", "is_json", "message")


@query("drop_noise", sql("SELECT line_id, value FROM routed WHERE route <> 'noise'", *COLLECT))
def drop_noise(spark, sf, ws):
    return collect.drop_noise(payloads(spark, sf)).select("line_id", "value")


@query("format_syslog", sql(f"SELECT line_id, {FORMATTED} AS output FROM fields WHERE fits", *COLLECT[:3]))
def format_syslog(spark, sf, ws):
    parsed = collect.parse_payloads(payloads(spark, sf)).filter("parsed is not null")
    return parsed.select("line_id", syslog.format_syslog(F.col("parsed")).alias("output"))


@query("route_records", sql(f"SELECT line_id, route, {OUTPUT} AS output FROM routed", *COLLECT))
def route_records(spark, sf, ws):
    return collect.route(payloads(spark, sf)).select("line_id", "route", "output")


# ---- rules --------------------------------------------------------------------------------------

TEMPLATE = "regexp_replace(content, '[0-9]+', '<*>', 'g')"
TEXT_SQL = f"lower({TEMPLATE} || ' ' || content)"
LABELED_CTE = f"labeled AS (SELECT *, {TEMPLATE} AS event_template, {TEXT_SQL} AS txt FROM logs)"


def templated(spark, sf):
    """The view with its content's digits masked as event template."""
    return logs(spark, sf).withColumn("event_template", F.regexp_replace("content", "[0-9]+", "<*>"))


def case_rules(then, otherwise):
    hits = [f"WHEN regexp_matches(txt, {quoted(p)}) THEN {then(c, p)}" for c, ps in RULES.items() for p in ps]
    return "CASE " + " ".join(hits) + f" ELSE {otherwise} END"


def _confidence_sql(category, pattern):
    import re
    found = " + ".join(f"CAST(contains(txt, {quoted(k)}) AS INT)" for k in re.findall(r"\w+", pattern.lower()))
    return (f"round(least({WEIGHTS[category]}::DOUBLE + {min(len(pattern) / 50, 0.3)}::DOUBLE + "
            f"least(0.05::DOUBLE * ({found}), 0.2::DOUBLE), 0.98::DOUBLE), 3)")


TYPE_SQL = case_rules(lambda c, p: quoted(c), "'normal'")
PATTERN_SQL = case_rules(lambda c, p: quoted(p), "NULL")
CONF_SQL = case_rules(_confidence_sql, "0.7::DOUBLE")
CRIT_SQL = f"log_type IN ({', '.join(map(quoted, CRITICAL_TYPES))})"
VERDICT_CTE = f"verdict AS (SELECT *, {TYPE_SQL} AS log_type, {PATTERN_SQL} AS matched_pattern, {CONF_SQL} AS confidence FROM labeled)"


def judged(spark, sf):
    return classify(templated(spark, sf), "v")


@query("classify_rules", sql("SELECT line_id, log_type, matched_pattern FROM verdict", LABELED_CTE, VERDICT_CTE))
def classify_rules(spark, sf, ws):
    return judged(spark, sf).select("line_id", "v.log_type", "v.matched_pattern")


@query("classify_batch", sql(f"SELECT log_type, confidence, matched_pattern, {CRIT_SQL} AS is_critical, count(*) AS n FROM verdict GROUP BY ALL",
                             LABELED_CTE, VERDICT_CTE))
def classify_batch(spark, sf, ws):
    return judged(spark, sf).groupBy("v.log_type", "v.confidence", "v.matched_pattern", "v.is_critical").agg(
        F.count(F.lit(1)).alias("n"))


@query("rule_confidence", sql("SELECT line_id, confidence FROM verdict", LABELED_CTE, VERDICT_CTE))
def rule_confidence(spark, sf, ws):
    return judged(spark, sf).select("line_id", "v.confidence")


@query("rule_is_critical", sql(f"SELECT line_id, {CRIT_SQL} AS is_critical FROM verdict", LABELED_CTE, VERDICT_CTE))
def rule_is_critical(spark, sf, ws):
    return judged(spark, sf).select("line_id", "v.is_critical")


@query("threat_flag", sql(f"SELECT line_id, log_type, log_type IN ({', '.join(map(quoted, THREAT_TYPES))}) AS is_threat FROM verdict",
                          LABELED_CTE, VERDICT_CTE))
def threat_flag(spark, sf, ws):
    from ..operators.dashboard import with_threat_flag
    return with_threat_flag(with_log_type(templated(spark, sf)).select("line_id", "log_type"), "log_type")


# ---- content features ---------------------------------------------------------------------------

def _flag(name):
    pattern = CONTENT_FLAGS[name]

    @query(name, sql(f"SELECT line_id, CAST(regexp_matches(content, {quoted(pattern)}, 'i') AS BIGINT) AS {name} FROM logs"))
    def flag(spark, sf, ws):
        return logs(spark, sf).select("line_id", text.has(F.col("content"), pattern).cast("long").alias(name))


for _name in CONTENT_FLAGS:
    _flag(_name)


@query("content_length", sql("SELECT line_id, CAST(length(content) AS BIGINT) AS content_length FROM logs"))
def content_length(spark, sf, ws):
    return logs(spark, sf).select("line_id", F.length("content").cast("long").alias("content_length"))


@query("content_word_count", sql("SELECT line_id, CAST(len(regexp_extract_all(content, '\\S+')) AS BIGINT) AS content_word_count FROM logs"))
def content_word_count(spark, sf, ws):
    return logs(spark, sf).select("line_id", text.word_count(F.col("content")).cast("long").alias("content_word_count"))
