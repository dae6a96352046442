"""Windows per key, and the pruned join of flagged windows."""

import random

from pyspark.sql import functions as F

from emberlog.operators import detect as dt, prune
from emberlog.operators.windows import keyed_windows, place_rows, sequence_windows
from emberlog.plans.batch import analyze_logs
from emberlog.plans.trained import Trained
from emberlog.streaming.count_windows import window_batch


def lines(n=500):
    """A hot key with two thirds of the rows, small keys, and rows without a key."""
    rng = random.Random(2)
    return [("hot" if rng.random() < 0.66 else rng.choice(["a", "b", "c", None]), 3 * i) for i in range(n)]


def expected(rows, size, stride):
    per = {}
    for key, at in sorted(rows, key=lambda r: r[1]):
        per.setdefault(key, []).append(at)
    return sorted(((k, s // stride, s, i - s, at) for k, v in per.items() for i, at in enumerate(v)
                   for s in range(0, len(v) - size + 1, stride) if s <= i < s + size), key=repr)


def test_windows_of_each_key(spark, ws, small_limits):
    df = spark.createDataFrame(lines(), "host string, at long").repartition(5)
    for size, stride in ((8, 8), (8, 4), (5, 2), (3, 7)):
        got = keyed_windows(df, "host", ["at"], ws, size, stride).select("host", "win_id", "start_idx", "offset", "at").collect()
        assert sorted(map(tuple, got), key=repr) == expected(lines(), size, stride)


def test_batch_windows_equal_those_of_a_stream(spark, ws):
    df = spark.createDataFrame(lines(), "host string, at long")
    out = ws.path("out")
    window_batch(df, 0, "host", ["at"], out, ws.path("carry"), ws)
    want = spark.read.parquet(out).select("host", "win_id", "offset", "at").collect()
    got = keyed_windows(df, "host", ["at"], ws).select("host", "win_id", "offset", "at").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)


def test_window_numbers_across_keys(spark, ws, small_limits):
    """No two windows of different keys share a number, and none holds two keys."""
    placed = place_rows(spark.createDataFrame(lines(), "host string, at long"), ["at"], ws, "host")
    windows = sequence_windows(placed.rows, placed.n, tail=True, place=placed.place)
    per = windows.groupBy("win_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.coalesce("host", F.lit("-"))).alias("keys"))
    assert per.filter("n <> 8 or keys <> 1").isEmpty() and placed.total == 500
    assert per.count() == len({(k, w) for k, w, *_ in expected(lines(), 8, 8)})


def test_detection_per_key_is_that_of_each_key(spark, ws):
    """With thresholds given, the flagged windows of all keys are those of every key on its own."""
    rng = random.Random(5)
    rows = [(k, i, f"connection from u{i}" if i % 3 else "authentication failure; user=u", rng.random(), rng.random()) for i, (k, _) in enumerate(lines(400))]
    df = spark.createDataFrame(rows, "host string, line_id long, content string, a double, b double")
    placed = place_rows(df, ["line_id"], ws, "host")
    model = dt.SeverityModel([0.5, 0.6, 0.7])
    found = dt.detect(placed.rows, placed.n, ws, "both", "a", "b", model, key="host")
    errors = {}
    for key in ("hot", "a", "b", "c", None):
        own = sorted(r for r in rows if r[0] == key)
        if not own:
            own = [r for r in rows if r[0] is None]
        own.sort(key=lambda r: r[1])
        for s in range(0, len(own) - 8, 8):
            errors[own[s][1]] = (key, sum(r[3] for r in own[s:s + 8]) / 8)
    limit = found.thresholds["sequential"]
    want = sorted((str(k), round(e, 9)) for k, e in errors.values() if e > limit)
    got = found.sequential.select("host", "anomaly_score").collect()
    assert sorted((str(k), round(e, 9)) for k, e in got) == want and len(errors) == found.errors.count()


def structured(n):
    rng = random.Random(n)
    kinds = ["Failed password for u{0} from 10.0.0.{1} port 9 ssh2", "session opened for user u{0}", "new user: uid={1}"]
    return [f"Jan 01 00:{i // 60 % 60:02d}:{i % 60:02d} h{i % 3} sshd[{i}]: " + rng.choice(kinds).format(rng.randrange(5), rng.randrange(9)) for i in range(n)]


def test_whole_run_per_key(spark, ws, tmp_path):
    (tmp_path / "log.txt").write_text("\n".join(structured(300)))
    from emberlog.sources.text import read_logs
    run = analyze_logs(read_logs(spark, str(tmp_path / "log.txt")), "Linux", ws, key="level")
    assert {"level", "win_id", "position"} <= set(run.detection.anomalies().columns)
    # 100 lines per host: windows start at 0, 8, ..., 88.
    assert run.detection.errors.count() == 36
    again = run.trained.score(run.structured, ws, key="level")
    plain = lambda d: sorted(repr(r) for r in d.errors.select("win_id", F.round("sequential_error", 9), F.round("single_error", 9)).collect())
    assert plain(again) == plain(run.detection)


def test_models_of_a_run_do_not_see_its_last_lines(spark, ws, tmp_path):
    """The one-call run learns as ``Trained.fit`` does: from the first 70 %."""
    rows = structured(400)
    (tmp_path / "log.txt").write_text("\n".join(rows))
    from emberlog.sources.text import read_logs
    run = analyze_logs(read_logs(spark, str(tmp_path / "log.txt")), "Linux", ws)
    own = Trained.fit(run.structured, ws)
    assert all((own.models[m].mean == run.trained.models[m].mean).all() for m in own.models)
    assert own.weights == run.trained.weights


def test_few_keys_are_joined_without_moving_the_rest(spark, ws, small_limits):
    rows = spark.range(20_000).withColumn("win_id", F.floor(F.col("id") / 8))
    keys = ws.stage(spark.range(0, 2500, 50).select(F.col("id").alias("win_id"), F.lit(1.5).alias("e")), "keys", measure=True)
    kept = prune.may_hold(rows, keys, "win_id")
    assert 50 * 8 <= kept.count() <= 50 * 8 + 80
    # Tables of a test are so small that Spark would broadcast them by itself.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    joined = prune.join_few(rows, keys, "win_id")
    assert sorted(r.id for r in joined.collect()) == sorted(i for i in range(20_000) if i // 8 % 50 == 0)
    plan = prune.join_few(rows, keys, "win_id")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The rows pass the filter before they are shuffled for the join.
    places = [plan.index(part) for part in ("SortMergeJoin", "Exchange hashpartitioning(win_id", "BroadcastHashJoin", "getbit")]
    assert places == sorted(places)


def test_keys_that_fit_move_no_rows(spark, ws):
    rows = spark.range(20_000).withColumn("win_id", F.floor(F.col("id") / 8))
    keys = ws.stage(spark.range(0, 2500, 50).select(F.col("id").alias("win_id")), "keys", measure=True)
    plan = prune.join_few(rows, keys, "win_id")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_hybrid_run_is_reported(spark, ws, tmp_path):
    rows = spark.createDataFrame([(i, f"authentication failure; user=u{i}", float(i % 97), float(i % 13)) for i in range(400)],
                                 "idx long, content string, sequential_error double, single_error double")
    found = dt.detect(rows, 400, ws, "hybrid")
    row = found.summary().first()
    assert row.hybrid_count == found.hybrid.count() > 0 and row.hybrid_threshold == found.thresholds["hybrid"]
    assert (row.sequential_count, row.single_log_count, row.sequential_threshold) == (0, 0, None)
    from emberlog.sources.sinks import write_reports
    write_reports(found, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r" / "hybrid_anomalies")).count() == row.hybrid_count
