"""Run the queries next to their checking SQL and report differences.

Usage: python tools/compare.py [--sf DIR] [--only PREFIX,PREFIX] [--cores N]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.checks import catalog  # noqa: E402
from tidemark.checks.fixtures import TABLES  # noqa: E402
from tidemark.session import local_session  # noqa: E402


def canonical(value):
    """Value in a form that compares across engines."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, Decimal)):
        value = float(value)
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return [canonical(v) for v in value]
    return value


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(canonical(r[i]) for i in order) for r in rows),
        key=lambda r: tuple((v is None, type(v).__name__, str(v)) for v in r),
    )


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, name: str, sf_dir: str):
    """(verdict, rows, spark seconds, check seconds, note)."""
    start = time.time()
    df = catalog.QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if name not in catalog.CHECKS:
        return "rows-only", len(got), took, 0.0, ""
    start = time.time()
    result = con.execute(catalog.CHECKS[name])
    columns = [d[0] for d in result.description]
    expected = result.fetchall()
    check = time.time() - start
    if sorted(columns) != sorted(df.columns):
        return "SCHEMA", len(got), took, check, f"{sorted(df.columns)} vs {sorted(columns)}"
    a, b = sorted_rows(df.columns, got), sorted_rows(columns, expected)
    if a == b:
        return "ok", len(got), took, check, ""
    first = next(((x, y) for x, y in zip(a, b) if x != y), None)
    return "DIFF", len(got), took, check, f"{len(a)} vs {len(b)} rows; first {str(first)[:700]}"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--only", default="")
    parser.add_argument("--cores", default="8")
    args = parser.parse_args()
    spark, con = local_session(args.cores), connect(args.sf)
    spark.sparkContext.setLogLevel("OFF")
    wanted = [p for p in args.only.split(",") if p]
    bad = 0
    for name in sorted(catalog.QUERIES):
        if wanted and not any(name.startswith(p) for p in wanted):
            continue
        try:
            verdict, rows, took, check, note = compare(spark, con, name, args.sf)
        except Exception as error:  # report and go on with the next query
            verdict, rows, took, check, note = "ERROR", 0, 0.0, 0.0, str(error)[:600]
        bad += verdict not in ("ok", "rows-only")
        print(f"{verdict:9} {name:32} rows={rows:<8} {took:6.1f}s check {check:5.1f}s {note}", flush=True)
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
