"""The ``logs`` view over ``events``, and SQL pieces shared by the oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..workspace import Workspace

# One text, valid in Spark SQL and DuckDB; {events} is the events table.
LOGS_SQL = """
SELECT event_id AS line_id, ts, event_type, k, value,
 'host-' || CAST(user_id % 5 AS STRING) AS host,
 CASE event_type WHEN 'error' THEN CASE WHEN k % 6 < 2 THEN 'sshd' ELSE 'kernel' END
   WHEN 'click' THEN 'su' WHEN 'view' THEN 'sshd' WHEN 'signup' THEN 'useradd' ELSE 'billing' END AS component,
 user_id AS pid,
 CASE WHEN event_type = 'error' THEN 'B' || CAST(k % 6 AS STRING) ELSE event_type END AS branch,
 CASE WHEN event_type='error' AND k % 6 = 0 THEN 'Failed password for invalid user u' || CAST(user_id AS STRING) || ' from 10.0.' || CAST(k AS STRING) || '.7 port ' || CAST(event_id + 1024 AS STRING) || ' ssh2'
  WHEN event_type='error' AND k % 6 = 1 THEN 'authentication failure; logname= uid=' || CAST(user_id AS STRING) || ' euid=0 tty=ssh ruser= rhost=10.0.0.' || CAST(k AS STRING)
  WHEN event_type='error' AND k % 6 = 2 THEN 'Out of memory: Killed process ' || CAST(event_id AS STRING) || ' (worker' || CAST(k AS STRING) || ')'
  WHEN event_type='error' AND k % 6 = 3 THEN 'connection timed out, peer 10.0.' || CAST(k AS STRING) || '.9'
  WHEN event_type='error' AND k % 6 = 4 THEN 'permission denied on /srv/u' || CAST(user_id AS STRING) || '/f' || CAST(k AS STRING)
  WHEN event_type='error' THEN 'Kernel panic - not syncing: Fatal exception'
  WHEN event_type='click' THEN 'session opened for user u' || CAST(user_id AS STRING) || ' by (uid=0)'
  WHEN event_type='view' THEN 'Accepted password for u' || CAST(user_id AS STRING) || ' from 10.1.0.' || CAST(k AS STRING) || ' port ' || CAST(event_id + 1024 AS STRING) || ' ssh2'
  WHEN event_type='signup' THEN 'new user: name=u' || CAST(user_id AS STRING) || ', uid=' || CAST(user_id AS STRING)
  ELSE 'order ' || CAST(event_id AS STRING) || ' charged to account ' || CAST(user_id AS STRING) END AS content,
 'Jan ' || lpad(CAST(day(ts) AS STRING),2,'0') || ' ' || lpad(CAST(hour(ts) AS STRING),2,'0') || ':' || lpad(CAST(minute(ts) AS STRING),2,'0') || ':' || lpad(CAST(second(ts) AS STRING),2,'0') AS stamp
FROM (SELECT *, CAST(regexp_extract(props,'([0-9]+)',1) AS INT) AS k FROM {events}) e
"""
LINE_SQL = ("SELECT *, stamp || ' ' || host || ' ' || component || '[' || CAST(pid AS STRING) || ']: ' || content AS line "
            "FROM ({logs}) l")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; one that is scanned by fewer tasks than there are cores is spread out."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_logs: dict[tuple[str, str], DataFrame] = {}


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``events`` table as log lines, written once per session like any collected log."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _logs:
        query = LINE_SQL.replace("{logs}", LOGS_SQL)
        _logs[key] = Workspace(spark).stage(spark.sql(query, events=table(spark, sf_dir, "events")), "logs")
    return _logs[key]


# ---- registration -------------------------------------------------------------------------------

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    """Register a query that takes (spark, sf_dir, workspace), and the SQL of its result."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark, sf_dir, Workspace(spark))

        run.__name__, run.__doc__ = key, fn.__doc__
        assert key not in QUERIES, key
        QUERIES[key] = run
        if oracle is not None:
            ORACLES[key] = oracle
        return fn

    return register


# ---- CTEs of the oracles ------------------------------------------------------------------------

LOGS_CTE = "logs AS (" + LINE_SQL.replace("{logs}", LOGS_SQL.replace("{events}", "events")) + ")"


def sql(final: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([LOGS_CTE, *ctes]) + "\n" + final


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"
