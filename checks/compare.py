"""Run every product in Spark and in DuckDB and compare rows.

``python -m checks.compare [folder] [name ...]``
"""

from __future__ import annotations

import math
import sys
import time
from datetime import date, datetime
from decimal import Decimal

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    if isinstance(value, Decimal):
        return repr(float(value))
    if isinstance(value, datetime):
        return value.isoformat()
    if isinstance(value, date):
        return value.isoformat()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    found = [tuple(normal(row[i]) for i in order) for row in rows]
    return sorted(found, key=repr)


def duckdb_views(folder: str):
    import duckdb

    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def difference(spark, connection, folder, name, query, sql) -> str | None:
    """None where both agree, else what differs."""
    df = query(spark, folder)
    ours = rows_of(df.columns, df.collect())
    answer = connection.execute(sql)
    names = [d[0] for d in answer.description]
    theirs = rows_of(names, answer.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{a} against {b}"
    return None


def main() -> None:
    from bench import session
    from checks.oracle import ORACLE
    from checks.queries import QUERIES

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(QUERIES)
    spark, connection = session(8), duckdb_views(folder)
    wrong = 0
    for name in chosen:
        start = time.perf_counter()
        found = difference(spark, connection, folder, name, QUERIES[name], ORACLE[name])
        wrong += found is not None
        rows = "ok" if found is None else "DIFFERS " + found[:600]
        print(f"{name:34} {time.perf_counter() - start:6.2f}s {rows}", flush=True)
    print(f"{len(chosen) - wrong} of {len(chosen)} agree")


if __name__ == "__main__":
    main()
