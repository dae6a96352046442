"""What was learned once scores other tables, in this session and after saving."""

import numpy as np
from pyspark.sql import functions as F

from emberlog.operators import templates as tm
from emberlog.operators.parsing import parse_preset
from emberlog.plans.presets import PRESETS
from emberlog.plans.trained import Trained


def parsed(spark, ws, n, odd=()):
    rng = np.random.default_rng(n)
    lines = []
    for i in range(n):
        host, port = f"10.0.0.{rng.integers(9)}", rng.integers(1000, 9999)
        kinds = [f"Failed password for u{rng.integers(5)} from {host} port {port} ssh2", f"session opened for user u{port}",
                 f"connection from {host} closed after {port} seconds", "Out of memory: Killed process", f"new user: uid={port}"]
        text = "Kernel panic - not syncing: Fatal exception" if i in odd else kinds[rng.integers(5)]
        # Numbers of lines may have gaps.
        lines.append((3 * i + 1, f"Jan 01 00:{i // 60 % 60:02d}:{i % 60:02d} h1 sshd[{rng.integers(99)}]: {text}"))
    df = spark.createDataFrame(lines, "line_id long, line string")
    rows = parse_preset(df, PRESETS["Linux"], "line", keep=["line_id"])
    return ws.stage(tm.mine(rows, PRESETS["Linux"], ws).events(rows), "parsed")


def plain(found):
    rows = found.anomalies().select("processing_mode", "win_id", "severity", F.round("anomaly_score", 9).alias("s"), "anomaly_type").collect()
    return sorted(map(repr, rows))


def test_saved_models_score_as_in_the_same_session(spark, ws, tmp_path):
    model = Trained.fit(parsed(spark, ws, 400), ws)
    other = parsed(spark, ws, 240, odd=(100, 101))
    here = model.score(other, ws)
    model.save(spark, str(tmp_path / "model"))
    again = Trained.load(spark, str(tmp_path / "model")).score(other, ws)
    assert plain(here) == plain(again)
    # Windows start at every multiple of 8 below n - 8, and the models are not fitted to these lines.
    assert here.errors.count() == 29 and here.errors.filter("sequential_error > 1e-6").count() == 29


def test_a_scorer_of_ones_own(spark, ws):
    model = Trained.fit(parsed(spark, ws, 400), ws)
    other = parsed(spark, ws, 240, odd=(50,))
    found = model.score(other, ws, mode="sequential", scorer=lambda windows: np.abs(windows).max(axis=1))
    assert found.single is None and found.errors.filter("sequential_error is null").count() == 0
