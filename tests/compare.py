"""Spark-vs-DuckDB comparison used by the tests and runnable on its own:

    python tests/compare.py [sf_dir] [query ...]

Columns are matched by name; rows are compared as multisets after
normalising values (floats rounded, arrays as tuples, NULL/NaN as None).
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from postlens.sources.testdata import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, bool):
        return int(v)
    return v


def _rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    rows = sorted((tuple(_norm(r[i]) for i in order) for r in records), key=repr)
    return cols, rows


def spark_rows(df):
    return _rows(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return _rows(cols, cur.fetchall())


def compare(spark, sf_dir, name, query, sql, con=None):
    con = con or duck(sf_dir)
    t0 = time.time()
    s_cols, s_rows = spark_rows(query(spark, sf_dir))
    t1 = time.time()
    d_cols, d_rows = duck_rows(con, sql)
    ok = s_cols == d_cols and s_rows == d_rows
    detail = ""
    if not ok:
        if s_cols != d_cols:
            detail = f"columns {s_cols} vs {d_cols}"
        else:
            ss, dd = set(s_rows), set(d_rows)
            detail = (
                f"rows {len(s_rows)} vs {len(d_rows)}; spark-only {sorted(ss - dd, key=repr)[:3]}"
                f" duck-only {sorted(dd - ss, key=repr)[:3]}"
            )
    return ok, len(s_rows), t1 - t0, detail


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as E

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(E.queries())
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", os.environ.get("COMPARE_TZ", "UTC"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names:
        if name not in sqls:
            n = qs[name](spark, sf_dir).count()
            print(f"{name:28s} rows-only  rows={n}")
            continue
        try:
            ok, n, secs, detail = compare(spark, sf_dir, name, qs[name], sqls[name], con)
        except Exception as e:  # report and continue
            ok, n, secs, detail = False, -1, 0.0, f"error {type(e).__name__}: {str(e)[:300]}"
        bad += not ok
        print(f"{name:28s} {'OK ' if ok else 'BAD'} rows={n:<6d} {secs:6.2f}s {detail}")
    print(f"{len(names) - bad}/{len(names)} match")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
