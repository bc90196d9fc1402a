"""Runs queries in Spark and their oracle SQL in DuckDB and compares all rows.

    python tests/compare.py [folder] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def _counted(names, rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(name: str, spark, sf_dir: str, connection, queries, oracle) -> str:
    """Empty text if both engines give the same columns and rows."""
    frame = queries[name](spark, sf_dir)
    spark_names, spark_rows = _counted(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = connection.execute(oracle[name])
    names = [d[0] for d in cursor.description]
    duck_names, duck_rows = _counted(names, cursor.fetchall())
    if spark_names != duck_names:
        return f"columns {spark_names} / {duck_names}"
    if spark_rows != duck_rows:
        only_spark, only_duck = spark_rows - duck_rows, duck_rows - spark_rows
        return (
            f"{sum(spark_rows.values())} / {sum(duck_rows.values())} rows, only Spark "
            f"{sum(only_spark.values())} {list(only_spark)[:2]}, only SQL "
            f"{sum(only_duck.values())} {list(only_duck)[:2]}"
        )
    return "" if spark_rows else "no rows"


def main() -> int:
    import __spark_entry__ as entry
    from kvitok.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    spark = local_session(8)
    connection = connect(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        if name not in oracle:
            outcome = f"rows only: {queries[name](spark, sf_dir).count()}"
        else:
            try:
                found = differences(name, spark, sf_dir, connection, queries, oracle)
            except Exception as error:  # report and go on with the next query
                found = f"{type(error).__name__}: {str(error)[:1500]}"
            failed += bool(found)
            outcome = f"DIFFERS {found}" if found else "ok"
        print(f"{name:28s} {time.time() - start:6.1f}s {outcome}", flush=True)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
