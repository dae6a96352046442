"""Nulls, zeros, equal names and long rows, on the ways for small and for large tables."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.functions import severity
from emberlog.operators import analytics as an, detect as dt, lookup, scoring as sc, templates as tm
from emberlog.operators.features import Tfidf
from emberlog.operators.indexing import index_rows, percentiles
from emberlog.operators.lookup import lookup_join
from emberlog.plans.presets import PRESETS
from emberlog.sources import streams, text as src
from emberlog.streaming.count_windows import window_batch
from emberlog.workspace import row_chars


@pytest.fixture(params=["small", "large"])
def either_way(request):
    if request.param == "large":
        request.getfixturevalue("small_limits")
    return request.param


def test_null_keys_are_numbered(spark, ws, either_way):
    rows = [(None if i % 3 == 0 else i % 3, i) for i in range(30)]
    df = ws.stage(spark.createDataFrame(rows, "g int, v int"), "rows", measure=True)
    got = index_rows(df, ["v"], ws, by=["g"]).collect()
    assert sorted((r.v, r.idx) for r in got) == [(i, i // 3) for i in range(30)]


def test_percentiles_are_equal_on_both_ways(spark, ws):
    values = np.random.default_rng(3).lognormal(size=997).tolist()
    df = spark.createDataFrame([(v,) for v in values], "v double")
    points = [i / 1000 for i in range(1, 1000)]
    one, two = (percentiles(df, "v", points, ws, in_memory_rows=n).first().pct for n in (10_000, 0))
    assert list(one) == list(two)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_with_long_hot_rows_and_nulls(spark, ws, either_way, monkeypatch, how):
    monkeypatch.setattr(lookup, "HOT_CHARS", 5)
    rows = [("a" * 9, i) for i in range(50)] + [(f"k{i}", i) for i in range(20)] + [(None, 1), ("lost", 2)]
    left = spark.createDataFrame(rows, "k string, v int").repartition(4)
    right = ws.stage(spark.createDataFrame([("a" * 9, "x" * 40, 50), *[(f"k{i}", f"n{i}", 1) for i in range(20)], (None, "null", 1)],
                                           "k string, name string, n int"), "right", measure=True)
    names = {k: n for k, n in [("a" * 9, "x" * 40), *[(f"k{i}", f"n{i}") for i in range(20)]]}
    for nulls in (False, True):
        known = names | ({None: "null"} if nulls else {})
        want = [(k, v, known.get(k)) for k, v in rows if how == "left" or k in known]
        got = lookup_join(left, right, ["k"], how, weight="n", nulls=nulls).select("k", "v", "name").collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_row_chars_counts_what_is_nested(spark):
    df = spark.createDataFrame([(["ab", "cde", None], {"k": "value"}, ("x" * 10, [1, 2]), None)],
                               "a array<string>, m map<string,string>, s struct<t:string,u:array<int>>, n array<string>")
    assert df.select(row_chars(df)).first()[0] >= 5 + 24 + 6 + 10 + 16


def test_lines_of_two_hosts_with_equal_names(spark, ws, tmp_path):
    for host in ("h1", "h2"):
        (tmp_path / host).mkdir()
        (tmp_path / host / "messages").write_text("".join(f"{host} {i}\n" for i in range(80)))
    rows = src.number_lines(src.read_logs(spark, [str(tmp_path / "h1"), str(tmp_path / "h2")]), ws).collect()
    assert [r.value for r in sorted(rows, key=lambda r: r.line_id)] == [f"{h} {i}" for h in ("h1", "h2") for i in range(80)]
    assert sorted(r.line_id for r in rows) == list(range(1, 161))


def test_union_csv_names_what_it_skips(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv.gz").write_bytes(gzip.compress(b"y,z\n5,6\n"))
    (tmp_path / "c.csv").write_bytes(b"\x00\xff\x00binary\n")
    skipped = []
    got = src.union_csv(spark, str(tmp_path / "*.csv*"), skipped).select("x", "y", "z").collect()
    assert sorted(map(tuple, got), key=str) == [("1", "2", None), (None, "5", "6")]
    assert [s.rsplit("/", 1)[1] for s in skipped] == ["c.csv"]


def test_lost_offsets_stop_the_stream():
    assert "failOnDataLoss" not in streams.kafka_options("host:9092")


def test_zero_thresholds_and_losses(spark):
    df = spark.createDataFrame([(0.0,), (0.5,)], "e double")
    got = [r[0] for r in df.select(severity.severity_confidence(F.col("e"), [0.0, 0.0, 0.0])).collect()]
    assert got == [0.1, 1.0]
    losses = spark.createDataFrame([(1, 0.0), (2, 0.5), (3, 0.0)], "model_id int, loss double")
    assert {r.model_id: r.w for r in dt.ensemble_weights(losses).collect()} == {1: 0.5, 2: 0.0, 3: 0.5}


def test_a_quiet_log_has_no_anomalies(spark, ws):
    """Rows of low rank leave no error, and no error is no anomaly."""
    rng = np.random.default_rng(0)
    basis = rng.normal(size=(3, 20))
    x = rng.integers(0, 4, (300, 3)) @ basis
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx long, x array<double>")
    full = sc.Reconstruction.fit(df, "x", 16)
    assert df.select(F.max(full.error(F.col("x")))).first()[0] == 0.0
    errors = sc.ensemble_errors(df, 300, "x", ws)
    assert errors.filter("mode = 'single_log'").agg(F.min("err")).first()[0] > 1e-6
    still = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(100)], "idx long, x array<double>")
    assert sc.ensemble_errors(still, 100, "x", ws).filter("err != 0").count() == 0


def test_scorers_use_all_rows(spark, ws):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    got = np.array([r.score for r in sc.rbf_novelty(df, "id", "x", ws).orderBy("id").collect()])
    gamma = 1.0 / (4 * x.var())
    squared = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    want = np.exp(-gamma * squared).mean(1)
    assert np.corrcoef(got, want)[0, 1] > 0.95 and abs(got - want).max() < 0.15
    forest = {r.id: r.prediction for r in sc.isolation_forest(df, "id", "x", ws).collect()}
    flagged = [i for i, p in forest.items() if p == -1]
    assert len(flagged) == 150 and np.abs(x[flagged]).max(1).mean() > 1.5 * np.abs(x).max(1).mean()


def test_missing_templates_and_content(spark, ws):
    lines = spark.createDataFrame([(1, "user root logged in"), (2, None), (3, "user bob logged in")], "line_id long, content string")
    found = tm.mine(lines, PRESETS["Linux"], ws).events(lines).orderBy("line_id").collect()
    assert [r.line_id for r in found] == [1, 2, 3] and found[1].event_id is None and found[0].event_id is not None
    rows = spark.createDataFrame([("a b <*>",), (None,), ("a c",)], "event_template string")
    model = Tfidf.fit(rows, min_df=1, max_df=1.0)
    got = [r.tfidf for r in model.transform(rows, ws).collect() if r.event_template is None]
    assert got == [[0.0] * len(model.terms)]


def test_overlapping_windows_count_a_log_once(spark):
    log = lambda i: (str(i),)
    rows = [("single_log", "High", log(1), None), ("sequential", "Low", None, [log(1), log(2)]),
            ("sequential", "Critical", None, [log(1), log(3)]), ("sequential", "Low", None, [log(2)])]
    df = spark.createDataFrame(rows, "processing_mode string, severity string, log struct<line_id:string>, logs array<struct<line_id:string>>")
    got = an.mode_overlap(df).first().asDict()
    assert got == {"both": 1, "single_only": 0, "sequential_only": 2, "escalated": 1, "reduced": 0, "consistent": 0}


def test_count_windows_of_null_keys_and_lost_carry(spark, ws, either_way):
    out, carry = ws.path("out"), ws.path("carry")
    rows = [(None if i % 3 else "a", i) for i in range(60)]
    for number in range(3):
        batch = spark.createDataFrame(rows[number * 20:number * 20 + 20], "host string, at long")
        window_batch(batch, number, "host", ["at"], out, carry, ws)
    got = spark.read.option("recursiveFileLookup", "true").parquet(out).select("host", "win_id", "offset", "at").collect()
    want = []
    for key in (None, "a"):
        mine = [at for k, at in rows if k == key]
        want += [(key, i // 8, i % 8, at) for i, at in enumerate(mine[:len(mine) // 8 * 8])]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    with pytest.raises(FileNotFoundError):
        window_batch(spark.createDataFrame([("a", 1)], "host string, at long"), 7, "host", ["at"], out, carry, ws)


def test_rotated_logs_are_written_by_every_task(spark, ws, monkeypatch):
    from emberlog.contract import io

    rows = spark.createDataFrame([(i, f"line {i % 50}") for i in range(120)], "k long, line string").repartition(4)
    monkeypatch.setattr(io, "logs", lambda *_: rows)
    made = io.combine_rotated_logs(spark, "", ws)
    assert len(made.inputFiles()) > 3
    assert {r.value: r.n for r in made.collect()} == {f"line {i}": 3 if i < 20 else 2 for i in range(50)}
