"""Streams give what the batch gives, over several batches and after a repeated batch."""

from pyspark.sql import functions as F

from emberlog.contract.text import payloads
from emberlog.operators import collect
from emberlog.sources import streams
from emberlog.streaming import jobs
from emberlog.streaming.count_windows import stream_count_windows, window_batch


def finish(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def write_files(df, order, path, n):
    df.repartitionByRange(n, order).write.parquet(path)


def test_parse_over_batches(spark, ws):
    rows = payloads(spark, "/root/testdata/sf0.001")
    source, out = ws.path("in"), ws.path("out")
    write_files(rows, "line_id", source, 3)
    stream = streams.stream_parquet(spark, source, rows.schema, files_per_batch=1)
    finish(jobs.stream_parse(stream, out, ws.path("checkpoint")))
    got = spark.read.parquet(out)
    assert got.select("batch_id").distinct().count() == 3
    want = collect.route(rows).filter("output is not null").select("route", "output")
    assert sorted(map(tuple, got.select("route", "output").collect())) == sorted(map(tuple, want.collect()))


def expected(rows, size):
    per = {}
    for key, at in sorted(rows, key=lambda r: r[1]):
        per.setdefault(key, []).append(at)
    return sorted((k, i // size, i % size, at) for k, v in per.items() for i, at in enumerate(v) if (i // size + 1) * size <= len(v))


def test_count_windows_carry_over(spark, ws, small_limits):
    rows = [("hot" if i % 3 else f"k{i % 11}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "host string, at long")
    source, out = ws.path("in"), ws.path("out")
    # File names do not follow the order, so each batch is numbered from its own files.
    for part in range(5):
        df.filter((F.col("at") >= part * 100) & (F.col("at") < part * 100 + 100)).coalesce(1).write.mode("append").parquet(source)
    stream = streams.stream_parquet(spark, source, df.schema, files_per_batch=1)
    finish(stream_count_windows(stream, "host", ["at"], out, ws.path("carry"), ws.path("checkpoint")))
    got = spark.read.parquet(out).select("host", "win_id", "offset", "at").collect()
    assert sorted(map(tuple, got)) == expected(rows, 8)


def test_repeated_batch_changes_nothing(spark, ws):
    out, carry = ws.path("out"), ws.path("carry")
    first = spark.createDataFrame([("a", i) for i in range(10)], "host string, at long")
    second = spark.createDataFrame([("a", i) for i in range(10, 23)] + [("b", 1)], "host string, at long")
    for number, batch in ((0, first), (0, first), (1, second), (1, second)):
        window_batch(batch, number, "host", ["at"], out, carry, ws)
    got = spark.read.parquet(out).select("host", "win_id", "offset", "at").collect()
    assert sorted(map(tuple, got)) == expected([("a", i) for i in range(23)] + [("b", 1)], 8)
