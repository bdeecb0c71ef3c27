"""Run queries next to their SQL: ``python tests/check_oracles.py [sf_dir] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import duckdb  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from lorekeep.session import get_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def plain(value):
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        value = value.replace(tzinfo=None)
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name: str, sf_dir: str) -> str:
    df = queries()[name](spark, sf_dir)
    cols, rows = normal(df.columns, df.collect())
    result = con.execute(oracle_sql()[name])
    want_cols, want = normal([d[0] for d in result.description], result.fetchall())
    if cols != want_cols:
        return f"columns {cols} != {want_cols}"
    if len(rows) != len(want):
        return f"{len(rows)} rows != {len(want)}"
    for got, exp in zip(rows, want):
        if got != exp or [type(a) for a in got] != [type(b) for b in exp]:
            return f"{got!r} != {exp!r}"
    return ""


if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    bad = 0
    for name in sys.argv[2:] or oracle_sql():
        start = time.time()
        try:
            problem = compare(spark, con, name, sf_dir)
        except Exception as exc:
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += bool(problem)
        print(f"{'BAD' if problem else 'ok '} {name} {time.time() - start:.1f}s {problem[:900]}", flush=True)
    print("bad:", bad)
