"""Compare registered queries with their oracle SQL: ``python tests/oracle_check.py [names]``."""

from __future__ import annotations

import datetime
import decimal
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


def duck(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canon(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(0.0 if value == 0 else value)
    if isinstance(value, decimal.Decimal):
        return f"decimal:{value}"
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canon(v) for v in value) + "]"
    return f"{type(value).__name__}:{value}"


def compare(df, con, sql):
    columns = sorted(df.columns)
    start = time.time()
    got = sorted(tuple(canon(r[c]) for c in columns) for r in df.collect())
    print(f"  collected in {time.time() - start:.1f}s", end=" ")
    result = con.sql(sql)
    names = list(result.columns)
    if sorted(names) != columns:
        return f"columns differ: {columns} / {sorted(names)}", len(got)
    order = [names.index(c) for c in columns]
    want = sorted(tuple(canon(row[i]) for i in order) for row in result.fetchall())
    if len(got) != len(want):
        return f"rows differ: {len(got)} / {len(want)}", len(got)
    for a, b in zip(got, want):
        if a != b:
            return f"values differ ({columns}):\n    spark {a}\n    duck  {b}", len(got)
    return "", len(got)


def main(names, sf_dir):
    import __spark_entry__ as entry
    from tallyhouse.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            print(f"  built in {time.time() - start:.1f}s", end=" ")
            if name in oracles:
                problem, n = compare(df, con, oracles[name])
            else:
                problem, n = "", df.count()
        except Exception as error:  # noqa: BLE001 - report and go on
            problem, n = f"{type(error).__name__}: {str(error)[:1500]}", 0
        bad += bool(problem)
        mark = "FAIL" if problem else ("ok  " if name in oracles else "rows")
        print(f"{mark} {name} rows={n} {time.time() - start:.1f}s {problem[:1800]}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:], os.environ.get("SF_DIR", "/root/testdata/sf0.01")) > 0)
