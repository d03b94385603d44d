"""Run registered queries against their SQL on the given tables and say where they differ.

``python -m tests.compare [sf] [query ...]``
"""

from __future__ import annotations

import collections
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def rows_of(columns: list[str], rows: list) -> collections.Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return collections.Counter(tuple(row[i] for i in order) for row in rows)


def difference(spark, connection, query, sql: str, sf_dir: str) -> tuple[int, list[str]]:
    """(rows, problems)."""
    frame = query(spark, sf_dir)
    got_rows = [tuple(r) for r in frame.collect()]
    result = connection.execute(sql)
    columns = [c[0] for c in result.description]
    if sorted(columns) != sorted(frame.columns):
        return len(got_rows), [f"columns {sorted(frame.columns)} != {sorted(columns)}"]
    got, wanted = rows_of(frame.columns, got_rows), rows_of(columns, result.fetchall())
    problems = []
    for label, extra in (("only here", got - wanted), ("only in SQL", wanted - got)):
        if extra:
            problems.append(f"{label}: {sum(extra.values())} rows, e.g. {sorted(extra, key=repr)[0]!r}")
    return len(got_rows), problems


def main() -> None:
    from tests.session import make_session
    from workload.oracle import ORACLE
    from workload.queries import QUERIES

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.001'}"
    spark, connection = make_session(), connect(sf_dir)
    for name in sys.argv[2:] or QUERIES:
        began = time.time()
        try:
            count, problems = difference(spark, connection, QUERIES[name], ORACLE[name], sf_dir)
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            count, problems = 0, [f"{type(error).__name__}: {str(error)[:600]}"]
        print(f"{'ok ' if not problems and count else 'BAD'} {name} {count} rows {time.time() - began:.1f}s", flush=True)
        for problem in problems:
            print("    ", problem[:1500], flush=True)


if __name__ == "__main__":
    main()
