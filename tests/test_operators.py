"""Properties and hand-made edge cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.functions import severity, text
from emberlog.operators import analytics, cleaning, collect, dashboard, detect as dt, features as ft, parsing, quality
from emberlog.operators import scoring as sc, templates as tm
from emberlog.operators.classify import classify
from emberlog.operators.indexing import index_rows, percentile_values, percentiles
from emberlog.operators.lookup import lookup_join
from emberlog.operators.windows import sequence_windows
from emberlog.plans.presets import PRESETS, Preset
from emberlog.sources import payloads, sinks, streams, text as src


# ---- joins, numbers, percentiles ----------------------------------------------------------------

@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join_with_a_hot_key(spark, ws, small_limits, how):
    left = spark.range(900).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    right = left.filter("k <> 7").groupBy("k").agg(F.count(F.lit(1)).alias("w"))
    want = sorted(map(tuple, left.join(right, "k", how).select("k", "id", "w").collect()), key=str)
    staged = ws.stage(right, "right", measure=True)
    assert sorted(map(tuple, lookup_join(left, staged, ["k"], how, weight="w").select("k", "id", "w").collect()), key=str) == want
    # Measured again when the table was not measured while staging.
    assert lookup_join(left, ws.stage(right, "right"), ["k"], how, weight="w").count() == len(want)


def test_index_rows(spark, ws, small_limits):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), (F.col("id") % 3).alias("g")).repartition(6)
    got = index_rows(rows, ["v"], ws).collect()
    assert all(r.idx == r.v for r in got) and len(got) == 1000
    per_key = {}
    for r in index_rows(rows, ["v"], ws, by=["g"]).orderBy("v").collect():
        assert r.idx == per_key.get(r.g, 0)
        per_key[r.g] = r.idx + 1
    assert index_rows(rows.limit(0), ["v"], ws).count() == 0


def test_percentiles_match_numpy(spark, ws):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.lognormal(size=700), np.full(300, 2.5)])  # one value fills 30 %
    rows = spark.createDataFrame([(float(v), int(i % 3)) for i, v in enumerate(values)], "v double, g int").repartition(5)
    points = [0.0, 0.25, 0.5, 0.85, 0.95, 0.99, 1.0]
    want = np.percentile(values, [p * 100 for p in points])
    for limit in (10**6, 0):
        got = percentiles(rows, "v", points, ws, in_memory_rows=limit).first().pct
        assert np.allclose(got, want, rtol=0, atol=1e-12)
        by = {r.g: r.pct for r in percentiles(rows, "v", points, ws, by=["g"], in_memory_rows=limit).collect()}
        for g in range(3):
            assert np.allclose(by[g], np.percentile(values[g::3], [p * 100 for p in points]), rtol=0, atol=1e-12)
    assert not [v for v in percentile_values(rows.limit(0), "v", [0.5], ws) if v is not None]


# ---- parsing ------------------------------------------------------------------------------------

def test_format_groups_and_optional_part():
    pattern, headers = text.compile_format(PRESETS["Mac"].log_format, atomic=False)
    assert headers["PID"] == (6, None) and headers["Address"] == (8, 7) and headers["Content"] == (9, None)
    assert pattern.startswith(r"^(.*?)\s+(.*?)")


def test_parse_without_pid_and_rejects(spark):
    lines = ["Jun 2 01:02:03 h sshd[5]: a b", "Jun 2 01:02:03 h su: x", "", "nothing", "Jun 2 01:02:03 h x[]: y",
             "Jun 2 01:02:03 h a\u0001b[7]: c\u0001d"]
    df = spark.createDataFrame([(i, l) for i, l in enumerate(lines)], "line_id long, value string")
    got = {r.line_id: (r.component, r.pid, r.content) for r in parsing.parse_preset(df, "Linux", keep=["line_id"]).collect()}
    assert got == {0: ("sshd", "5", "a b"), 1: ("su", None, "x"), 4: ("x", "", "y"), 5: ("a\u0001b", "7", "c\u0001d")}
    rejects = parsing.parse_logs(df, PRESETS["Linux"].log_format, rejects=True)
    assert {r.line_id for r in rejects.collect()} == {2, 3}


def test_atomic_formats_fit_the_same_lines(spark):
    """Against the plain pattern in the scripting engine, on random lines of few characters."""
    import re
    rng = np.random.default_rng(5)
    lines = ["".join(rng.choice(list("ab  :[]-/,|=1()"), size=int(rng.integers(5, 30)))) for _ in range(1500)]
    lines += ["x y\nz w v u: c", "Jun 2  3 h k: c", "a b c d no colon " * 40, "a b c d e[5]: f\ng"]
    df = spark.createDataFrame([(i, l) for i, l in enumerate(lines)], "line_id long, value string")
    for name in ("Linux", "Spark", "Mac", "HPC", "OpenStack", "Zookeeper"):
        pattern, headers = text.compile_format(PRESETS[name].log_format, atomic=False)
        want = {}
        for i, l in enumerate(lines):
            m = None if len(l) > 200 else re.search(pattern, l.strip())
            if m:
                want[i] = tuple(m.group(headers[h][0]) for h in headers)
        got = {r[0]: tuple(r[1:]) for r in parsing.parse_preset(df, name, keep=["line_id"]).collect()}
        assert {k: v for k, v in got.items() if len(lines[k]) <= 200} == want


def test_words(spark):
    df = spark.createDataFrame([(" a=1,b  c:",), ("",), ("x9",), ("abcdefg123",), ("ab12345<*>",)], "c string")
    norm = text.normalized(F.col("c"), PRESETS["Linux"])
    got = df.select(norm.alias("n"), text.words(norm).alias("w"), text.is_parameter(F.col("c")).alias("p")).collect()
    assert got[0].n == " a= 1, b c: " and got[0].w == ["", "a=", "1,", "b", "c:", ""]
    assert got[1].w == [""] and [r.p for r in got] == [False, False, True, True, True]  # 3 of 10 digits is enough


def test_non_ascii_letters_end_no_word(spark):
    df = spark.createDataFrame([("préerror",), ("an error",), (None,)], "c string")
    got = [r[0] for r in df.select(text.has(F.col("c"), r"\b(error)\b")).collect()]
    assert got == [0, 1, 0]


def test_routes(spark):
    line = "Jun 12 18:27:51 h systemd[1]: Started"
    cases = {
        line: ("formatted", line),
        "Jun  2 18:27:51 h systemd[1]: two spaces": ("unrecognized", "Jun  2 18:27:51 h systemd[1]: two spaces"),
        "17": ("unrecognized", "17"),
        '{"message": broken': ("unrecognized", '{"message": broken'),
        '{"message": "Filebeat started"}': ("noise", None),
        "Jun 12 18:27:51 h filebeat[1]: x": ("noise", None),
        '{"message": "  "}': ("empty", None),
        '{"message": " hello ", "host": {"hostname": "h"}}': ("short", "unknown h unknown: hello"),
        json.dumps({"message": line}): ("formatted", line),
        "Jun 12 18:27:51 h my.prog[3]: dotted": ("formatted", "Jun 12 18:27:51 h my.prog[3]: dotted"),
        "Jun 12 18:27:51 h su: ": ("formatted", "Jun 12 18:27:51 h su: "),
        None: ("invalid", None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "value string")
    got = {r.value: (r.route, r.output) for r in collect.route(df).collect()}
    assert got == cases


def test_payload_gate(spark):
    df = spark.createDataFrame([('[{"anomaly_type": "x"}, {"anomaly_type": "y"}]',), ("{}",), ("[",), ("7",), (None,)], "value string")
    assert sorted(r.anomaly_type for r in payloads.accept_payloads(df).collect()) == ["x", "y"]
    assert payloads.reject_payloads(df).count() == 4


# ---- mining -------------------------------------------------------------------------------------

def brute_force(lines, threshold):
    """Templates by definition, for a handful of lines of single-spaced words."""
    rows = [l.split(" ") for l in lines]
    freq = {}
    for r in rows:
        for i, w in enumerate(r):
            freq[i, w] = freq.get((i, w), 0) + 1
    groups = {}
    for at, r in enumerate(rows):
        f = [freq[i, w] for i, w in enumerate(r)]
        best = max(dict.fromkeys(f), key=lambda x: (f.count(x), -f.index(x)))
        groups.setdefault((len(r), best, f.count(best)), []).append(at)
    out = {}
    for (_, root, _), members in groups.items():
        first = rows[members[0]]
        variable = set()
        for i, w in enumerate(first):
            if freq[i, w] != root:
                seen = {rows[m][i] for m in members}
                if len(seen) >= threshold:
                    variable |= seen
        for m in members:
            mask = lambda w: "<*>" in w or (w and sum(c.isdigit() for c in w) / len(w) >= 0.3)
            out[m] = " ".join("<*>" if w in variable or mask(w) else w for w in rows[m])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_mining_matches_definition(spark, ws, seed, small_limits):
    rng = np.random.default_rng(seed)
    vocabulary = ["open", "close", "user", "root", "by", "for", "x1", "77", "host", "net"]
    names = [f"n{chr(97 + i)}" for i in range(12)]
    lines = []
    for _ in range(150):
        shape = int(rng.integers(3))
        name = names[int(rng.integers(len(names)))]
        word = vocabulary[int(rng.integers(len(vocabulary)))]
        lines.append([f"open session for {name} by {word}", f"{word} closed {name} now", f"{name} for {name} by root {word}"][shape])
    preset = Preset("<Content>", threshold=int(rng.integers(2, 6)))
    df = spark.createDataFrame(list(enumerate(lines)), "line_id long, content string").repartition(5)
    got = {r.line_id: r.event_template for r in tm.mine(df, preset, ws).events(df).collect()}
    assert got == brute_force(lines, preset.threshold)


def test_mining_the_same_under_repartition(spark, ws):
    df = spark.createDataFrame([(i, f"login of u{i % 7} from host{i % 3} ok{i}") for i in range(60)], "line_id long, content string")
    runs = []
    for n in (1, 7):
        events = tm.mine(df.repartition(n), "Linux", ws).events(df)
        runs.append(sorted(map(tuple, events.select("line_id", "event_id", "event_template").collect())))
    assert runs[0] == runs[1]


# ---- windows, severity, detection ---------------------------------------------------------------

@pytest.mark.parametrize("n,length,stride,starts", [(8, 8, 8, []), (16, 8, 8, [0]), (17, 8, 8, [0, 8]), (20, 8, 4, [0, 4, 8]), (0, 8, 8, [])])
def test_window_starts(spark, n, length, stride, starts):
    rows = spark.range(n).select(F.col("id").alias("idx"))
    windows = sequence_windows(rows, n, length, stride)
    got = {r.start_idx: r["count"] for r in windows.groupBy("start_idx").count().collect()}
    assert got == {s: length for s in starts}


def test_equal_scores_flag_nothing(spark, ws):
    errors = spark.createDataFrame([(i, 2.0) for i in range(20)], "win_id long, e double")
    assert dt.flag_windows(errors, "e", dt.flag_threshold(errors, "e", ws)).count() == 0


def test_severity_at_and_between_thresholds(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (1.5,), (2.0,), (3.0,), (3.3,), (9.0,)], "e double")
    got = [tuple(r) for r in df.select(severity.severity(F.col("e"), [1.0, 2.0, 3.0]),
                                       F.round(severity.severity_confidence(F.col("e"), [1.0, 2.0, 3.0]), 3)).collect()]
    assert got == [("Low", 0.5), ("Low", 0.1), ("Medium", 1.0), ("Medium", 1.0), ("High", 1.0), ("Critical", 0.6), ("Critical", 1.0)]


def test_dominant_type_tie_goes_to_the_first(spark):
    lines = ["connection refused", "x", "oom", "connection refused", "oom", "x", "x", "x"] * 3
    rows = spark.createDataFrame([(i, i, l, l, "h", "c", "t") for i, l in enumerate(lines)],
                                 "idx long, line_id long, content string, event_template string, level string, component string, time string")
    flagged = spark.createDataFrame([(0, 5.0)], "win_id long, e double")
    seq = dt.sequential_anomalies(sequence_windows(rows, len(lines)), flagged, "e", dt.SeverityModel([1.0, 2.0, 3.0])).first()
    assert seq.anomaly_type == "network_error" and seq.non_normal_count == 4 and len(seq.logs) == 8


def test_detect_in_one_mode_and_summary(spark, ws):
    rows = spark.range(200).select(F.col("id").alias("idx"), F.col("id").alias("line_id"), F.lit("t").alias("time"), F.lit("l").alias("level"),
                                   F.lit("c").alias("component"), F.lit("out of memory").alias("content"), F.lit("out of memory").alias("event_template"),
                                   (F.col("id") % 17).cast("double").alias("sequential_error"), (F.col("id") % 13).cast("double").alias("single_error"))
    found = dt.detect(rows, 200, ws, "sequential")
    assert found.single is None and found.sequential.count() >= 1
    both = dt.detect(rows, 200, ws)
    row = both.summary().first()
    assert row.total_logs == 200 and row.single_log_count == both.single.count() > 0
    flagged = {r.win_id for r in dt.flag_windows(both.errors, "single_error", both.thresholds["single_log"]).collect()}
    assert {r.win_id for r in both.single.collect()} == flagged
    with pytest.raises(ValueError):
        dt.detect(rows, 200, ws, "none")


def test_rule_order_and_confidence(spark):
    df = spark.createDataFrame([("permission denied",), ("kernel panic",), ("Fatal",), ("fine",), (None,)], "c string")
    v = [r.v for r in classify(df.withColumn("t", F.lit(None).cast("string")), "v", "t", "c").collect()]
    assert [x.log_type for x in v] == ["filesystem_error", "memory_error", "system_critical", "normal", "normal"]
    assert [x.confidence for x in v] == [0.98, 0.98, 0.98, 0.7, 0.7] and [x.is_critical for x in v] == [False, False, True, False, False]


# ---- cleaning and features ----------------------------------------------------------------------

def test_cleaning_small_and_null(spark, ws):
    schema = "line_id long, level string, component string, content string, event_template string, event_id string"
    rows = [(1, None, None, "all fine here", "t", "E0"), (2, "ERROR", "x", "fine", "t", "E0"), (3, "INFO", "Kernel", "fine", "t", "E0"),
            (4, "INFO", "x", "disk full", "t", "E0"), (5, "INFO", "x", "also fine here", None, "E0")]
    df = spark.createDataFrame(rows, schema)
    staged = cleaning.with_stage(df, ws, aggressive=False)
    assert {r.line_id: r.dropped_at for r in staged.collect()} == {1: None, 2: "level", 3: "component", 4: "content", 5: "keys"}
    # One survivor has no deviation, so nothing is within.
    assert cleaning.clean_training_data(df.filter("line_id = 1"), ws).count() == 0
    assert cleaning.cleaning_report(staged.limit(0)).first().removed_pct == 0.0


def test_infrequent_bucket_keeps_later_of_equals(spark):
    df = spark.createDataFrame([(f"c{i:02d}",) for i in range(6)] + [("c00",)], "c string")
    assert ft.fit_categories(df, "c", 4) == (["c00", "c04", "c05"], True)
    assert ft.fit_categories(df, "c", 6) == ([f"c{i:02d}" for i in range(6)], False)
    row = spark.createDataFrame([("c01",), ("c05",)], "c string").select(ft.one_hot(F.col("c"), ["c00", "c04", "c05"], True)).collect()
    assert [r[0] for r in row] == [[0, 0, 0, 1], [0, 0, 1, 0]]
    unseen = spark.createDataFrame([("zz",)], "c string").select(ft.one_hot(F.col("c"), ["a"], False)).first()[0]
    assert unseen == [0]


def test_preprocessor_round_trip(spark, ws):
    df = spark.createDataFrame([(f"user login{'x' * (i % 4)} failed port {i}", f"user login failed port {i % 5}", "h", f"c{i % 3}", "E0") for i in range(40)],
                               "content string, event_template string, level string, component string, event_id string")
    fitted = ft.Preprocessor.fit(df, ws)
    path = ws.path("saved")
    fitted.save(spark, path)
    again = ft.Preprocessor.load(spark, path)
    a, b = (np.array([r.features.toArray() for r in p.transform(df, ws).select("content", "features").orderBy("content").collect()]) for p in (fitted, again))
    assert np.array_equal(a, b) and np.allclose(a.mean(axis=0), 0, atol=1e-9)
    spread = a.std(axis=0)
    assert np.all(np.isclose(spread, 1) | np.isclose(spread, 0))


def test_quality_of_empty_and_bare_tables(spark):
    bare = spark.createDataFrame([("x",)], "content string")
    row = quality.validate_columns(bare).first()
    assert not row.valid and row.missing_required == "event_template,event_id"
    empty = spark.createDataFrame([], "event_template string, event_id string, content string")
    assert quality.quality_issues(empty).first().issues == []


# ---- scorers ------------------------------------------------------------------------------------

@pytest.fixture
def vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6)) @ rng.normal(size=(6, 6))
    x[:20] *= 6
    return x, spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(x)], "id long, idx long, x array<double>")


def test_reconstruction_matches_numpy(vectors):
    x, df = vectors
    centred = x - x.mean(axis=0)
    values, directions = np.linalg.eigh(np.cov(centred.T))
    errors = []
    for k in (0, 2, 4, 6):
        top = directions[:, ::-1][:, :k]
        want = ((centred - centred @ top @ top.T) ** 2).mean(axis=1)
        got = [r[0] for r in df.orderBy("id").select(sc.Reconstruction.fit(df, "x", k).error(F.col("x"))).collect()]
        assert np.allclose(got, want, atol=1e-8)
        errors.append(np.mean(got))
    assert errors == sorted(errors, reverse=True)


def test_ensemble_and_custom_model(vectors, ws):
    x, df = vectors
    errors = sc.ensemble_errors(df, 400, "x", ws, sizes=(2, 4))
    assert errors.groupBy("model_id", "mode").count().filter("count = 49").count() == 4
    windows = sc.flat_windows(df, 400, "x")
    custom = sc.custom_errors(windows, lambda batch: (batch ** 2).mean(axis=1)).orderBy("win_id").collect()
    assert np.allclose([r.err for r in custom], [(x[i:i + 8] ** 2).mean() for i in range(0, 392, 8)])


@pytest.mark.parametrize("detector", [sc.isolation_forest, sc.rbf_novelty, sc.pca_norm])
def test_detectors_find_the_far_rows(vectors, ws, detector):
    _, df = vectors
    a = {r.id: (round(r.score, 9), r.prediction) for r in detector(df, "id", "x", ws).collect()}
    b = {r.id: (round(r.score, 9), r.prediction) for r in detector(df.repartition(7), "id", "x", ws).collect()}
    assert a == b
    flagged = [i for i, (_, p) in a.items() if p == -1]
    assert len(flagged) == 20 and sum(i < 20 for i in flagged) >= 12


# ---- sources, sinks, analytics ------------------------------------------------------------------

def test_rotated_files_in_order(spark, ws, tmp_path):
    import bz2
    import gzip
    (tmp_path / "messages").write_bytes(b"a1\n  a2  \nbad\xff byte\n")
    (tmp_path / "messages.1.gz").write_bytes(gzip.compress(b"b1\nb2\n"))
    (tmp_path / "messages.2.bz2").write_bytes(bz2.compress(b"c1\n"))
    (tmp_path / "messagesother").write_text("no\n")
    rows = src.number_lines(src.read_rotated(spark, str(tmp_path)), ws)
    assert [(r.line_id, r.value) for r in rows.orderBy("line_id").collect()] == [
        (1, "a1"), (2, "a2"), (3, "bad byte"), (4, "b1"), (5, "b2"), (6, "c1")]


def test_line_numbers_over_many_splits(spark, ws, tmp_path):
    lines = [f"line {i:05d}" for i in range(5000)]
    (tmp_path / "log").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows = src.read_logs(spark, str(tmp_path / "log"))
        assert rows.select("block").distinct().count() > 3
        kept = src.number_lines(rows.filter("value not like '%7'"), ws)
        got = [r.value for r in kept.orderBy("line_id").collect()]
        assert got == [l for l in lines if not l.endswith("7")]
        assert kept.agg(F.max("line_id")).first()[0] == len(got)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_union_of_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,z\n5,6\n")
    (tmp_path / "c.csv").write_text("")
    got = src.union_csv(spark, str(tmp_path / "*.csv")).select("x", "y", "z").collect()
    assert sorted(map(tuple, got), key=str) == [("1", "2", None), (None, "5", "6")]


def test_export_retries(spark):
    calls, waits = [], []

    def write(df):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("down")

    assert sinks.export_batch(spark.range(1), write, sleep=waits.append) == 3 and waits == [1.0, 2.0]
    with pytest.raises(OSError):
        sinks.export_batch(spark.range(1), lambda df: (_ for _ in ()).throw(OSError("down")), sleep=lambda s: None)


def test_kafka_options():
    got = streams.kafka_options("host:1")
    assert got["subscribe"] == "server-logs" and got["startingOffsets"] == "latest" and got["kafka.group.id"] == "log-consumer-group"


def test_empty_store(spark, ws):
    empty = spark.createDataFrame([], "processing_mode string, anomaly_type string, severity string, confidence double, anomaly_score double")
    stats = analytics.score_statistics(empty, ws).collect()
    assert len(stats) == 2 and all(r.n == 0 and r.p99 == 0 for r in stats)
    assert analytics.threshold_effectiveness(empty, ws).count() == 0
    assert dashboard.threat_share(empty).first().threat_pct == 0.0
    assert dt.threat_level(empty).first().threat_level == "NORMAL"


def test_top_anomalies_limits_before_the_shuffle(spark, capsys):
    store = spark.range(100).select((F.col("id") % 2).alias("processing_mode"), F.col("id").alias("position"), F.array(F.lit("c")).alias("contents"))
    top = dashboard.top_anomalies(store, "position")
    assert top.count() == 6
    top.explain()
    assert "WindowGroupLimit" in capsys.readouterr().out
