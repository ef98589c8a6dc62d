"""Run queries and their SQL side by side and report differences.

    python tests/compare.py [folder of the tables] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connection(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows_of(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if both results hold the same columns and rows, else what differs."""
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b and [list(map(type, r)) for r in a] == [list(map(type, r)) for r in b]:
        return None
    left, right = set(map(repr, a)) - set(map(repr, b)), set(map(repr, b)) - set(map(repr, a))
    return (f"{len(a)} rows != {len(b)} rows, {len(left)} differ, e.g.\n   spark {sorted(left)[:1]}\n   sql   {sorted(right)[:1]}")


if __name__ == "__main__":
    from tests.conftest import session

    from reckoner.oracle import oracle_sql
    from reckoner.queries import QUERIES

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con, sql = session(), connection(folder), oracle_sql()
    for name in sys.argv[2:] or QUERIES:
        start = time.time()
        if name not in sql:
            print(f"----  {name}: {len(QUERIES[name](spark, folder).collect())} rows, no SQL, {time.time() - start:.1f}s", flush=True)
            continue
        try:
            found = differences(QUERIES[name](spark, folder), con, sql[name])
        except Exception as e:  # noqa: BLE001
            found = f"{type(e).__name__}: {str(e).split('JVM stacktrace')[0][:600]}"
        print(f"{'ok   ' if found is None else 'DIFF '} {name} {time.time() - start:.1f}s {found or ''}", flush=True)
