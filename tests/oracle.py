"""Run named queries next to their SQL and compare.

    python tests/oracle.py [folder] [name ...]
"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def cell(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(cell(v) for v in value) + "]"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(row[i]) for i in order) for row in rows)


def difference(spark, con, folder, name, query, sql):
    """None if both give the same table, else a short account of what differs."""
    frame = query(spark, folder)
    got_columns, got = rows_of(frame.columns, frame.collect())
    if sql is None:
        return None if got else "no rows"
    result = con.execute(sql)
    want_columns, want = rows_of([d[0] for d in result.description], result.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if got != want:
        first = next(((g, w) for g, w in zip(got, want) if g != w), None)
        return f"{len(got)} rows != {len(want)} rows; first difference {str(first)[:600]}"
    return None if got else "both empty"


def main():
    from __spark_entry__ import oracle_sql, queries
    from issuelens import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    spark = build_session("oracle", master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name in names:
        start = time.time()
        try:
            found = difference(spark, con, folder, name, queries()[name], oracle_sql().get(name))
        except Exception as error:  # report and go on with the next query
            found = f"{type(error).__name__}: {str(error)[:900]}"
        failed += found is not None
        kind = "sql " if name in oracle_sql() else "rows"
        print(f"{'ok  ' if found is None else 'FAIL'} {kind} {time.time() - start:6.2f}s {name} {found or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} ok")


if __name__ == "__main__":
    main()
