"""Run registered queries and their SQL on the same tables and compare the rows.

    python tests/compare.py [folder] [name …]
"""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def sql_rows(folder: str, sql: str) -> tuple[list[str], list[str], list[tuple]]:
    db = duckdb.connect()
    for file in sorted(os.listdir(folder)):
        name = file.removesuffix(".parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{file}')")
    result = db.sql(sql)
    return result.columns, [str(kind) for kind in result.types], result.fetchall()


# The SQL type of each Spark type the queries return.
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def compare(spark, folder: str, build, sql: str, may_be_empty: bool = False) -> str | None:
    """None if the rows are the same, else what differs."""
    frame = build(spark, folder)
    names, types, expected = sql_rows(folder, sql)
    if sorted(names) != sorted(frame.columns):
        return f"columns {frame.columns} against {names}"
    kinds = {n: TYPES.get(k, k) for n, k in frame.dtypes}
    wrong = {n: (kinds[n], k) for n, k in zip(names, types) if kinds[n] not in (k, k.removesuffix("EGER"))}
    if wrong:
        return f"types {wrong}"
    rows = [tuple(row) for row in frame.select(*names).collect()]
    if Counter(rows) != Counter(expected):
        only = list((Counter(rows) - Counter(expected)).elements())[:3]
        missing = list((Counter(expected) - Counter(rows)).elements())[:3]
        return f"{len(rows)} rows against {len(expected)}; only here {only}, missing {missing}"
    return None if rows or may_be_empty else "no rows"


def main() -> int:
    import __spark_entry__ as entry
    from evenkeel.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", spark__sql__shuffle__partitions=8, spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    queries, sqls = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or queries:
        started = time.time()
        try:
            problem = compare(spark, folder, queries[name], sqls[name])
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{name:32} {time.time() - started:6.2f}s  {problem or 'ok'}", flush=True)
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(main())
