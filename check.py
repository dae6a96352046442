"""Compare queries with their SQL oracles: python check.py [sf] [key ...]"""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time

import duckdb

from emberlog.contract.registry import ORACLES, QUERIES
from emberlog.session import local_session

DATA = os.environ.get("TESTDATA", "/root/testdata")


def plain(value):
    """A value as both engines should show it."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, decimal.Decimal)):
        return int(value) if value == int(value) else float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return 0.0 if value == 0 else value
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(out, key=repr)


def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def compare(spark, con, key, sf_dir):
    """(verdict, rows, seconds of Spark, seconds of DuckDB)."""
    start = time.time()
    df = QUERIES[key](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    spent = time.time() - start
    if key not in ORACLES:
        return "rows-only", len(got), spent, 0.0
    start = time.time()
    res = con.execute(ORACLES[key])
    names = [d[0] for d in res.description]
    want = res.fetchall()
    oracle_spent = time.time() - start
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(names)}", len(got), spent, oracle_spent
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        return f"COUNT {len(a)} vs {len(b)} e.g. {a[:1]} / {b[:1]}", len(got), spent, oracle_spent
    for x, y in zip(a, b):
        if x != y or [type(i) for i in x] != [type(i) for i in y]:
            return f"VALUES {x} vs {y}", len(got), spent, oracle_spent
    return "ok", len(got), spent, oracle_spent


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    keys = sys.argv[2:] or list(QUERIES)
    sf_dir = f"{DATA}/sf{sf}"
    spark, con = local_session(8), duck(sf_dir)
    bad = 0
    for key in keys:
        try:
            verdict, n, spent, oracle_spent = compare(spark, con, key, sf_dir)
        except Exception as error:  # report and go on
            verdict, n, spent, oracle_spent = f"ERROR {type(error).__name__}: {str(error)[:600]}", 0, 0, 0
        bad += verdict not in ("ok", "rows-only")
        print(f"{key:28s} {n:7d} {spent:6.2f}s {oracle_spent:6.2f}s  {verdict}", flush=True)
    print(f"{len(keys)} queries, {bad} wrong")


if __name__ == "__main__":
    main()
