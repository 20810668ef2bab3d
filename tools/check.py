"""Runs registered queries beside their SQL and compares the results.

    python tools/check.py [--sf DIR] [name ...]
"""
from __future__ import annotations

import argparse
import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tessera.session import local_session  # noqa: E402
from tessera.workload.catalogue import ORACLES, QUERIES  # noqa: E402
from tessera.workload.inputs import TABLES  # noqa: E402


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, decimal.Decimal)):
        return f"{float(value):.9g}" if isinstance(value, decimal.Decimal) else f"{value:.9g}" if abs(value) > 2**53 else str(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat(sep=" ")
    return str(value)


def compare(df, oracle, sql: str | None) -> tuple[str, int]:
    """What differs between a result and its SQL ('' for nothing), and the row count."""
    columns = sorted(df.columns)
    rows = [tuple(row[c] for c in columns) for row in df.collect()]
    if sql is None:
        return "", len(rows)
    cursor = oracle.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    if [names[i] for i in order] != columns:
        return f"columns {columns} != {sorted(names)}", len(rows)
    a = sorted(tuple(map(canonical, row)) for row in rows)
    b = sorted(tuple(canonical(row[i]) for i in order) for row in cursor.fetchall())
    if a == b:
        return "", len(rows)
    first = next(((x, y) for x, y in zip(a, b) if x != y), None)
    return f"{len(a)} vs {len(b)} rows; {first}", len(rows)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session(8)
    oracle = duckdb.connect()
    for name in TABLES:
        oracle.execute(f"CREATE VIEW {name} AS SELECT * FROM '{args.sf}/{name}.parquet'")
    failed = []
    for name in args.names or QUERIES:
        started = time.time()
        try:
            problem, n_rows = compare(QUERIES[name](spark, args.sf), oracle, ORACLES.get(name))
        except Exception as error:  # noqa: BLE001
            problem, n_rows = f"{type(error).__name__}: {error}", 0
        verdict = "FAIL" if problem else "ok  " if name in ORACLES else "rows"
        print(f"{verdict} {name:28s} {n_rows:7d} rows {time.time() - started:6.1f}s {problem[:600]}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
