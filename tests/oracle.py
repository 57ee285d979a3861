"""Runs registered queries next to their SQL in DuckDB and compares whole results.

``python tests/oracle.py [sf dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    """One spelling per value, keeping int / float / text apart."""
    if isinstance(value, float):
        return "null" if math.isnan(value) else f"f{value!r}"
    if isinstance(value, decimal.Decimal):
        return f"dec{value}"
    if isinstance(value, (datetime.date, datetime.datetime)):
        return f"t{value}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return "null" if value is None else f"{type(value).__name__}:{value}"


def as_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> str:
    """Empty when equal, otherwise what differs."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = as_rows(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    got = as_rows(df.columns, [tuple(r) for r in df.collect()])
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, first: {sorted(names)} spark {bad[0][0]} sql {bad[0][1]}" if bad else ""


def main() -> None:
    import __spark_entry__ as entry
    from visitline.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="12g", spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="visitline-shared-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    failed = []
    for name, fn in entry.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = compare(fn(spark, sf_dir), con, sqls[name])
                outcome = problem or "equal"
            else:
                problem, outcome = "", f"rows {len(fn(spark, sf_dir).collect())} (no SQL)"
        except Exception as exc:  # noqa: BLE001
            problem = outcome = f"{type(exc).__name__}: {str(exc)[:600]}"
        if problem:
            failed.append(name)
        print(f"{'FAIL' if problem else 'ok  '} {name:38s} {time.time() - start:6.2f}s {outcome}", flush=True)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
