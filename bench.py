"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS, BENCH_WARMUPS; BENCH_REPEAT: how often the events are repeated, with shifted
ids, for the run of template mining over a larger log (10; 0 leaves it out). All queries read a
``logs`` table that the warm-up has staged; the larger log is staged before it is timed too.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from emberlog.contract.base import LINE_SQL, LOGS_SQL, table
from emberlog.contract.registry import QUERIES
from emberlog.operators.templates import mine
from emberlog.session import local_session
from emberlog.workspace import Workspace

HEADLINE = ["mine_templates", "parse_log_format", "classify_rules", "route_records", "clean_training_data",
            "detect_modes", "tfidf_templates", "parsing_stats", "line_index", "stream_count_windows"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    # Small tables on one machine: small partitions keep all cores busy; the code cache holds all plans.
    spark = local_session(cpus, "bench", **{
        "spark.sql.files.openCostInBytes": "65536",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
        "spark.sql.codegen.cache.maxEntries": "2000",
    })

    def once(key: str) -> float:
        start = time.time()
        QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.time() - start

    lines = table(spark, sf_dir, "events").count()
    for _ in range(int(os.environ.get("BENCH_WARMUPS", "1"))):
        for key in HEADLINE:
            once(key)
    seconds = {key: round(once(key), 3) for key in HEADLINE}
    larger = {}
    if repeat := int(os.environ.get("BENCH_REPEAT", "10")):
        ws = Workspace(spark)
        events = table(spark, sf_dir, "events")
        shift = events.agg(F.max("event_id") + 1).first()[0]
        many = (events.withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))))
                .withColumn("event_id", F.col("event_id") + F.col("_turn") * shift).drop("_turn"))
        big = ws.stage(spark.sql(LINE_SQL.replace("{logs}", LOGS_SQL), events=many), "many_logs")
        start = time.time()
        mine(big, "Linux", ws).events(big).write.format("noop").mode("overwrite").save()
        spent = time.time() - start
        larger = {"lines": lines * repeat, "sec": round(spent, 3), "lines_per_sec": round(lines * repeat / spent)}
        ws.drop()
    print(json.dumps({"metric": "headline_queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus), "lines": lines,
                      "mining_lines_per_sec": round(lines / seconds["mine_templates"]),
                      "logs_staged_before": True, "mining_larger": larger}))


if __name__ == "__main__":
    main()
