"""Compare registered queries with their SQL: python tests/check_oracle.py [sf_dir] [name ...]."""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def compare(spark, con, sf_dir, name, fn, sql):
    t = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - t
    if sql is None:
        return True, f"rows only: {len(got)}", spent
    rel = con.sql(sql)
    columns = rel.columns
    want = rows_of(columns, rel.fetchall())
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} want {sorted(columns)}", spent
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        missing = [r for r in want if r not in set(got)][:3]
        return False, f"{len(got)} rows want {len(want)}; extra {extra} missing {missing}", spent
    return True, f"{len(got)} rows equal", spent


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from echoledger.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session(
        master="local[8]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions="8", spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(sf_dir), oracle_sql(), []
    for name, fn in queries().items():
        if names and name not in names:
            continue
        try:
            ok, note, spent = compare(spark, con, sf_dir, name, fn, oracles.get(name))
        except Exception as e:
            ok, note, spent = False, f"{type(e).__name__}: {str(e)[:600]}", 0.0
        bad += [] if ok else [name]
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {spent:6.1f}s {note}", flush=True)
    print("failed:", bad)
