"""Compare registered queries with their DuckDB counterparts: python tests/check_oracle.py [sf or folder] [name prefix ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import __spark_entry__ as entry  # noqa: E402
from gaugeline.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("set TimeZone='UTC'")
    for name in TABLES:
        connection.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return connection


def plain(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return repr(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, connection, name, folder):
    """(problem or None, row count, seconds)"""
    start = time.time()
    frame = entry.queries()[name](spark, folder)
    got_columns, got = rows_of(frame.columns, frame.collect())
    seconds = time.time() - start
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None, len(got), seconds
    result = connection.execute(sql)
    want_columns, want = rows_of([d[0] for d in result.description], result.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}", len(got), seconds
    if got != want:
        extra, missing = set(got) - set(want), set(want) - set(got)
        sample = f"only spark {sorted(extra)[:3]} only duckdb {sorted(missing)[:3]}"
        return f"rows {len(got)} vs {len(want)}: {got_columns} {sample}", len(got), seconds
    return None, len(got), seconds


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:])
    folder = sf if sf.startswith("/") else f"/root/testdata/sf{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(folder)
    failed = 0
    for name in entry.queries():
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            problem, count, seconds = compare(spark, connection, name, folder)
        except Exception as error:  # report and go on with the next query
            problem, count, seconds = f"{type(error).__name__}: {str(error)[:1500]}", -1, 0.0
        failed += problem is not None
        kind = "" if name in entry.oracle_sql() else " (rows only)"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name}{kind} {count} rows {seconds:.1f}s {problem or ''}", flush=True)
    print("failed:", failed)
