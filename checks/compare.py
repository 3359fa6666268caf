"""Run queries next to their SQL and compare the rows.

    python -m checks.compare /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from checks.oracles import ORACLES
from checks.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple[str, ...]]]:
    """Column names in order, and all rows as text in order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def spark_rows(spark, sf_dir: str, name: str):
    df = QUERIES[name](spark, sf_dir)
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def oracle_rows(connection, name: str):
    cursor = connection.execute(ORACLES[name])
    return rows_of([d[0] for d in cursor.description], cursor.fetchall())


def main() -> int:
    from broadsheet.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, connection, bad = local_session(8), connect(sf_dir), 0
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        start = time.time()
        try:
            ours = spark_rows(spark, sf_dir, name)
            took = time.time() - start
            if name not in ORACLES:
                print(f"rows  {name}: {len(ours[1])} in {took:.2f}s", flush=True)
                continue
            theirs = oracle_rows(connection, name)
        except Exception as error:  # report and go on with the next query
            bad += 1
            print(f"FAIL  {name}: {str(error)[:600]}", flush=True)
            continue
        if ours == theirs:
            print(f"ok    {name}: {len(ours[1])} in {took:.2f}s", flush=True)
        else:
            bad += 1
            only_ours = [r for r in ours[1] if r not in set(theirs[1])][:2]
            only_theirs = [r for r in theirs[1] if r not in set(ours[1])][:2]
            print(f"DIFF  {name}: {len(ours[1])} vs {len(theirs[1])} rows; {ours[0]} {theirs[0]}\n"
                  f"   ours {str(only_ours)[:700]}\n   sql  {str(only_theirs)[:700]}", flush=True)
    print(f"{bad} of {len(names)} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main())
