"""Run every query next to its check in DuckDB and compare values.

usage: check.py [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from tsengine.plans.catalog import ORACLES, QUERIES
from tsengine.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    made = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(made, key=lambda t: [(v is None, str(v)) for v in t])


def close(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= 1e-9 * max(1.0, abs(a), abs(b))
    return a == b


def compare(spark, con, name: str, folder: str) -> tuple[str, int, float, float]:
    t = time.time()
    df = QUERIES[name](spark, folder)
    rows = [tuple(row) for row in df.collect()]
    took = time.time() - t
    if name not in ORACLES:
        return "rows only", len(rows), took, 0.0
    t = time.time()
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    wanted = result.fetchall()
    sql_took = time.time() - t
    left, right = canonical(df.columns, rows), canonical(names, wanted)
    if left[0] != right[0]:
        return f"COLUMNS {left[0]} {right[0]}", len(rows), took, sql_took
    if len(rows) != len(wanted):
        return f"ROWS {len(rows)} {len(wanted)}", len(rows), took, sql_took
    exact = sum(a != b for a, b in zip(left[1], right[1]))
    wrong = [(a, b) for a, b in zip(left[1], right[1]) if not all(map(close, a, b))]
    if wrong:
        return f"VALUES {len(wanted)} rows, {len(wrong)} differ, e.g. {wrong[0]}", len(rows), took, sql_took
    kinds = {(type(a).__name__, type(b).__name__) for x, y in zip(left[1], right[1]) for a, b in zip(x, y)}
    odd = [k for k in kinds if k[0] != k[1] and "NoneType" not in k]
    return f"ok{f' (last digits: {exact})' if exact else ''}{f' TYPES {odd}' if odd else ''}", len(rows), took, sql_took


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session(
        "check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names:
        try:
            verdict, count, took, sql_took = compare(spark, con, name, folder)
        except Exception as error:  # noqa: BLE001 - report and go on
            verdict, count, took, sql_took = f"ERROR {type(error).__name__}: {str(error)[:600]}", 0, 0.0, 0.0
        bad += not verdict.startswith(("ok", "rows only"))
        print(f"{name:26} {count:8} rows {took:6.2f}s {sql_took:6.2f}s  {verdict}", flush=True)
    print(f"{len(names) - bad} of {len(names)} fine")
    return bad


if __name__ == "__main__":
    sys.exit(main())
