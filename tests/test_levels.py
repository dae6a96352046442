"""Tables changed by batches stay small in files, forget quiet keys, and survive repeated batches."""

import time

import pytest
from pyspark.sql import functions as F

from emberlog.plans.rulebook import THREAT_TYPES
from emberlog.sources import streams
from emberlog.streaming import jobs
from emberlog.streaming.count_windows import state_count_windows, window_batch
from emberlog.streaming.levels import Levels


def finish(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def expected(rows, size):
    per = {}
    for key, at in sorted(rows, key=lambda r: r[1]):
        per.setdefault(key, []).append(at)
    return sorted(((k, i // size, i % size, at) for k, v in per.items() for i, at in enumerate(v) if (i // size + 1) * size <= len(v)), key=repr)


def test_levels_over_fifty_batches(spark, ws):
    levels = Levels(spark, ws.path("levels"), ["k"], fan_in=4)
    want, most = {}, 0
    for n in range(50):
        if n:
            levels.compact(n - 1)
        # Each batch changes three keys; batch 7 and its null key come twice, as after a failure.
        changed = {f"k{(n * 3 + i) % 11}" if i else None: 100 * n + i for i in range(3)}
        for _ in range(2 if n == 7 else 1):
            levels.write(spark.createDataFrame(list(changed.items()), "k string, v long").coalesce(1), n)
        want |= changed
        most = max(most, len(levels._covers()))
    got = {r.k: r.v for r in levels.read().collect()}
    assert got == want
    # Three folders a level at most, and up to four new ones before they are merged.
    assert most <= 3 * 3 + 4 and levels.live()[0] == (0, 15)
    before = {r.k: r.v for r in levels.read(48).collect()}
    levels.compact(48)
    assert {r.k: r.v for r in levels.read(48).collect()} == before


def test_merged_batches_are_not_lost(spark, ws):
    levels = Levels(spark, ws.path("levels"), ["k"], fan_in=2)
    for n in range(4):
        levels.write(spark.createDataFrame([(n, n)], "k long, v long"), n)
    levels.compact(3)
    assert levels.live() == [(0, 3)] and levels._covers() == [(0, 3)]
    assert sorted(r.k for r in levels.read().collect()) == [0, 1, 2, 3]
    levels.write(spark.createDataFrame([(9, 9)], "k long, v long"), 5)
    with pytest.raises(FileNotFoundError, match="batch 4"):
        levels.read(5)


def test_quiet_keys_are_forgotten(spark, ws):
    out, carry = ws.path("out"), ws.path("carry")
    sizes = []
    for n in range(20):
        rows = [(f"new{n}", n * 10), *[("steady", n * 10 + i) for i in range(1, 4)]] + [(None, n * 10 + 5)] * (n % 2)
        window_batch(spark.createDataFrame(rows, "host string, at long").coalesce(1), n, "host", ["at"], out, carry, ws, idle=5)
        if n % 10 == 9:
            sizes.append(Levels(spark, carry, ["host"], 5).read(n).count())
    # One key of a batch is never seen again.
    assert sizes == [8] * 2
    got = spark.read.parquet(out).filter("host = 'steady' or host is null").select("host", "win_id", "offset", "at").collect()
    steady = [("steady", n * 10 + i) for n in range(20) for i in range(1, 4)] + [(None, n * 10 + 5) for n in range(1, 20, 2)]
    assert sorted(map(tuple, got), key=repr) == expected(steady, 8)
    held = Levels(spark, carry, ["host"], 5).read().collect()
    assert max(len(r._left) for r in held) < 8


def test_a_key_that_comes_back_begins_anew(spark, ws):
    out, carry = ws.path("out"), ws.path("carry")
    for n in range(6):
        rows = [("a", n * 100 + i) for i in range(10)] if n in (0, 5) else [("b", n * 100)]
        window_batch(spark.createDataFrame(rows, "host string, at long"), n, "host", ["at"], out, carry, ws, idle=2)
    got = spark.read.parquet(out).filter("host = 'a'").select("win_id", "offset", "at").collect()
    assert sorted(map(tuple, got)) == sorted([(0, i, i) for i in range(8)] + [(0, i, 500 + i) for i in range(8)])


def test_totals_read_few_folders(spark, ws):
    types = sorted(THREAT_TYPES)[:4]
    rows = spark.createDataFrame([(i, types[i % 4]) for i in range(600)], "i long, anomaly_type string")
    source, out = ws.path("in"), ws.path("out")
    rows.repartitionByRange(30, "i").write.parquet(source)
    stream = streams.stream_parquet(spark, source, rows.schema, files_per_batch=1)
    finish(jobs.stream_threat_counts(stream, out, ws.path("checkpoint")))
    assert sorted(map(tuple, jobs.latest_counts(spark, out, ["anomaly_type"]).collect())) == [(t, 150) for t in types]
    assert len(Levels(spark, out, ["anomaly_type"]).live()) <= 3 + 8


def test_windows_from_the_state_store(spark, ws):
    rows = [(["hot", "a", None][i % 3 if i % 5 else 0], i) for i in range(480)]
    df = spark.createDataFrame(rows, "host string, at long")
    source, out = ws.path("in"), ws.path("out")
    for part in range(6):
        df.filter((F.col("at") >= part * 80) & (F.col("at") < part * 80 + 80)).coalesce(1).write.mode("append").parquet(source)
    windows = state_count_windows(streams.stream_parquet(spark, source, df.schema, files_per_batch=1), "host", ["at"])
    finish(jobs.each_batch(windows, lambda b, n: jobs.write_batch(b, out, n), ws.path("checkpoint")))
    got = spark.read.parquet(out).select("host", "win_id", "offset", "at").collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows, 8)


def test_the_state_store_forgets_quiet_keys(spark, ws):
    """A key of its own in each of 50 batches; after a second without records it goes."""
    source = ws.path("in")
    df = spark.createDataFrame([("steady" if i % 2 else f"new{i}", i) for i in range(100)], "host string, at long")
    df.repartitionByRange(50, "at").write.parquet(source)
    windows = state_count_windows(streams.stream_parquet(spark, source, df.schema, files_per_batch=1), "host", ["at"], idle_ms=1000)
    # A query with time-outs by the clock has no end of its own.
    query = jobs.each_batch(windows, lambda b, n: jobs.write_batch(b, ws.path("out"), n), ws.path("checkpoint")).start()
    end, seen = time.time() + 120, {}
    while time.time() < end and sum(p["numInputRows"] for p in seen.values()) < 100:
        time.sleep(0.2)
        seen |= {p["batchId"]: p for p in query.recentProgress}
    query.stop()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in seen.values() if p["stateOperators"]]
    assert sum(p["numInputRows"] for p in seen.values()) == 100 and max(held) < 30
