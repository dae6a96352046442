"""Stored results: templates, catalogue, rule verdicts, flagged windows, collected lines."""

import csv
import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import GOLDEN
from emberlog.functions import syslog
from emberlog.operators import collect, detect as dt, parsing, templates as tm
from emberlog.operators.classify import classify, with_log_type
from emberlog.operators.indexing import index_rows
from emberlog.operators.windows import sequence_windows
from emberlog.plans.presets import PRESETS
from emberlog.plans.rulebook import SEVERITY_PERCENTILES
from emberlog.sources.text import read_structured


def stored(name):
    with open(os.path.join(GOLDEN, name)) as f:
        return json.load(f) if name.endswith(".json") else list(csv.DictReader(f))


@pytest.fixture
def logs(spark):
    rows = read_structured(spark, os.path.join(GOLDEN, "structured.csv"))
    return rows.withColumn("line_id", F.col("line_id").cast("long"))


def check_mining(logs, ws):
    found = tm.mine(logs.drop("event_id", "event_template"), "Linux", ws)
    got = {r.line_id: (r.event_id, r.event_template) for r in found.events(logs.select("line_id", "content")).collect()}
    want = {int(r["LineId"]): (r["EventId"], r["EventTemplate"]) for r in stored("structured.csv")}
    assert got == want and len(got) == 69
    catalogue = {r.event_id: r.occurrences for r in found.catalogue.collect()}
    assert catalogue == {r["EventId"]: int(r["Occurrences"]) for r in stored("catalogue.csv")}


def test_templates_and_event_ids(logs, ws):
    check_mining(logs, ws)


def test_templates_on_the_ways_for_large_tables(logs, ws, small_limits):
    check_mining(logs.repartition(7), ws)


def test_rule_verdicts(logs):
    counts = with_log_type(logs).groupBy("log_type").count().collect()
    assert {r.log_type: r["count"] for r in counts} == {"authentication_error": 16, "normal": 53}
    assert classify(logs).filter("verdict.log_type = 'authentication_error' and verdict.confidence = 0.98").count() == 16
    alone = with_log_type(logs.withColumn("event_template", F.lit(None).cast("string")))
    assert alone.filter("log_type <> 'normal'").count() == 6


def test_flagged_windows(logs, ws):
    """Given the stored scores, the stored anomalies come out (severity thresholds were not stored)."""
    rows = index_rows(logs, ["line_id"], ws)
    n = rows.count()
    windows = sequence_windows(rows, n)
    assert [r.start_idx for r in windows.select("start_idx").distinct().orderBy("start_idx").collect()] == list(range(0, 64, 8))
    model = dt.SeverityModel([1.0, 2.0, 3.0], SEVERITY_PERCENTILES)
    single = dt.single_log_anomalies(windows, rows.sparkSession.createDataFrame([(3, 13.38849533021492)], "win_id long, e double"), "e", model)
    got = [json.loads(r) for r in single.select("log", "anomaly_type", "timestamp", "anomaly_score", "processing_mode").toJSON().collect()]
    want = [{k: r[k] for k in ("log", "anomaly_type", "timestamp", "anomaly_score", "processing_mode")} for r in stored("single.json")]
    assert sorted(got, key=lambda r: int(r["log"]["line_id"])) == want
    seq = dt.sequential_anomalies(windows, rows.sparkSession.createDataFrame([(2, stored("sequential.json")[0]["anomaly_score"])], "win_id long, e double"), "e", model)
    got = json.loads(seq.drop("win_id", "position", "severity", "confidence").toJSON().first())
    want = {k: v for k, v in stored("sequential.json")[0].items() if k not in ("severity", "confidence")}
    assert got == want


def test_collected_lines_are_stable(spark):
    """A line that some layout fits is formatted to itself."""
    lines = spark.read.text(os.path.join(GOLDEN, "collected.txt")).select("value")
    rows = collect.parse_payloads(lines).select("value", "parsed", syslog.format_syslog(F.col("parsed")).alias("out")).collect()
    fitting = [r for r in rows if r.parsed]
    assert len(fitting) > 60
    assert [r.out for r in fitting] == [r.value for r in fitting]


def test_structured_lines_parse_back(spark, logs):
    """Joining the stored columns gives lines that the Linux layout takes apart again."""
    pid = F.when(F.col("pid").isNull(), "").otherwise(F.concat(F.lit("["), "pid", F.lit("]")))
    line = F.concat_ws(" ", "month", "date", "time", "level", F.concat("component", pid, F.lit(":")), "content")
    simple = logs.filter("line_id > 1")
    back = parsing.parse_logs(simple.select("line_id", line.alias("value")), PRESETS["Linux"].log_format, keep=["line_id"])
    columns = ["line_id", "month", "date", "time", "level", "component", "pid", "content"]
    assert sorted(map(tuple, back.select(columns).collect())) == sorted(map(tuple, simple.select(columns).collect()))
