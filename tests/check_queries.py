"""Run registered queries next to their SQL and compare rows exactly (a tool, not a pytest file)."""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402
from tidewatch.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def rows_of(columns: list[str], rows: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(repr(r[i] + 0.0 if isinstance(r[i], float) else r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, folder: str) -> str:
    start = time.time()
    df = entry.queries()[name](spark, folder)
    got = df.collect()
    took = time.time() - start
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows {len(got)} {took:.1f}s {name}"
    start = time.time()
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    sql_took = time.time() - start
    if sorted(df.columns) != sorted(columns):
        return f"FAIL {name}: columns {sorted(df.columns)} vs {sorted(columns)}"
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a != b:
        return f"FAIL {name}: {len(got)} vs {len(want)} rows; spark only {list((a - b).items())[:2]}; sql only {list((b - a).items())[:2]}"
    return f"ok {len(got)} {took:.1f}s sql {sql_took:.1f}s {name}"


if __name__ == "__main__":
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    chosen = sys.argv[1:]
    for query_name in entry.queries():
        if chosen and not any(query_name.startswith(c) for c in chosen):
            continue
        try:
            print(compare(spark, con, query_name, folder), flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"ERROR {query_name}: {str(e)[:700]}", flush=True)
