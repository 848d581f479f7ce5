"""Run registered queries beside their SQL: ``python tests/check_queries.py [sf] [name …]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

import __spark_entry__ as entry
from skeinlog.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"create view {table} as select * from read_parquet('{sf_dir}/{table}.parquet')")
    return db


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def canonical(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def compare(spark, db, name: str, sf_dir: str) -> str:
    frame = entry.queries()[name](spark, sf_dir)
    got = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows only: {len(got[1])}"
    cursor = db.execute(sql)
    wanted = canonical([c[0] for c in cursor.description], cursor.fetchall())
    if got == wanted:
        return f"ok {len(got[1])}"
    lines = [f"DIFFERS columns {got[0]} / {wanted[0]} rows {len(got[1])} / {len(wanted[1])}"]
    left, right = set(map(repr, got[1])), set(map(repr, wanted[1]))
    lines += [f"   spark {r[:300]}" for r in sorted(left - right)[:3]]
    lines += [f"   sql   {r[:300]}" for r in sorted(right - left)[:3]]
    return "\n".join(lines)


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    directory = f"/root/testdata/sf{sf}"
    spark, db = local_session(8), connect(directory)
    bad = 0
    for name in sys.argv[2:] or list(entry.queries()):
        began = time.time()
        try:
            result = compare(spark, db, name, directory)
        except Exception as error:  # noqa: BLE001 - report and go on
            result = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        bad += result.startswith(("DIFF", "ERR"))
        print(f"{name:36s} {time.time() - began:6.1f}s {result}", flush=True)
    print(f"{bad} bad")
