"""Runs registered queries in Spark and in DuckDB and compares the sorted results.

    python tests/compare.py [--sf 0.01] [key ...]
"""

from __future__ import annotations

import argparse
import glob
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def session(cpus: int = 8) -> SparkSession:
    return (SparkSession.builder.master(f"local[{cpus}]").appName("diegrid")
            .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
            .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
            .config("spark.ui.showConsoleProgress", "false").getOrCreate())


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def normal(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, float):
        return (2, repr(v + 0.0))
    return (3, str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in rows)


def difference(spark, con, query, sql, sf_dir) -> str | None:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got[1] else "no rows"
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} / {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} / {len(want[1])}; {got[1][:2]} / {want[1][:2]}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if bad:
        return f"{len(bad)} of {len(got[1])} rows differ, first {[tuple(x[1] for x in bad[0][0])]} / {[tuple(x[1] for x in bad[0][1])]} types {[x[0] for x in bad[0][0]]}/{[x[0] for x in bad[0][1]]}"
    return None


if __name__ == "__main__":
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("keys", nargs="*")
    args = ap.parse_args()
    import __spark_entry__ as entry
    spark, sf_dir = session(), f"/root/testdata/sf{args.sf}"
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    qs, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for key in args.keys or qs:
        t = time.time()
        try:
            msg = difference(spark, con, qs[key], sql.get(key), sf_dir)
        except Exception as e:
            msg = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += msg is not None
        print(f"{'ok  ' if msg is None else 'FAIL'} {key}{'' if key in sql else ' (rows)'} {time.time() - t:.1f}s {msg or ''}", flush=True)
    print(f"{bad} failures")
