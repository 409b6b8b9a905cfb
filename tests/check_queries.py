"""Run registered queries next to their SQL in DuckDB and compare the rows.

    python tests/check_queries.py [sf] [name-part or suite module ...]
"""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


def plain(value):
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, decimal.Decimal)):
        return repr(float(value))
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    return str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def duck(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def compare(spark, con, folder, name, run, sql):
    """None when equal, else what differs."""
    df = run(spark, folder)
    columns, rows = normal(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if rows else "no rows"
    answer = con.execute(sql)
    want_columns, want = normal([d[0] for d in answer.description], answer.fetchall())
    if columns != want_columns:
        return f"columns {columns} != {want_columns}"
    if not rows:
        return "no rows"
    if rows != want:
        found, wanted = set(rows), set(want)
        extra = [r for r in rows if r not in wanted][:3]
        lacking = [r for r in want if r not in found][:3]
        return f"{len(rows)} rows against {len(want)}\n  columns {columns}\n  spark {extra}\n  sql   {lacking}"
    return None


def main():
    arguments = sys.argv[1:]
    scale = arguments[0] if arguments else "0.01"
    folder = f"/root/testdata/sf{scale}"
    import __spark_entry__ as entry
    from loupe.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    sqls, bad, slow = entry.oracle_sql(), [], []
    parts = arguments[1:]
    chosen = {
        n: q for n, q in entry.queries().items()
        if not parts or any(a in n or q.__module__.endswith("." + a) for a in parts)
    }
    for name, run in chosen.items():
        start = time.time()
        try:
            problem = compare(spark, con, folder, name, run, sqls.get(name))
        except Exception as error:  # noqa: BLE001 - reported per query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        took = time.time() - start
        slow.append((took, name))
        print(f"{'ok  ' if problem is None else 'FAIL'} {took:6.2f}s {'' if name in sqls else '(rows) '}{name}", flush=True)
        if problem:
            bad.append(name)
            print("  ", problem, flush=True)
    print(f"{len(chosen) - len(bad)} of {len(chosen)} good; slowest: {sorted(slow, reverse=True)[:8]}")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
