"""Run registered queries beside their DuckDB SQL and compare rows.

    python -m checks.compare [--sf DIR] [query ...]
"""

from __future__ import annotations

import argparse
import math
import time
from collections import Counter
from datetime import date, datetime

import duckdb
from pyspark.sql import SparkSession

from checks.oracle import oracle_sql
from checks.queries import QUERIES
from trailmark.session import build_session

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (datetime, date)):
        return v.isoformat()
    return v


def _counted(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark: SparkSession, con, sf_dir: str, name: str, sql: str) -> str | None:
    """None if both sides agree, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    ours = _counted(df.columns, df.collect())
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns: spark {sorted(df.columns)} duckdb {sorted(columns)}"
    theirs = _counted(columns, result.fetchall())
    if ours == theirs:
        return None
    left, right = list((ours - theirs).items())[:3], list((theirs - ours).items())[:3]
    return f"rows {ours.total()} / {theirs.total()}; only spark: {left}; only duckdb: {right}; columns {sorted(columns)}"


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session("compare", spark__master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__log__level="ERROR", spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    con, oracles = connect(args.sf), oracle_sql()
    bad = 0
    for name in args.names or QUERIES:
        began = time.time()
        try:
            problem = compare(spark, con, args.sf, name, oracles[name])
        except Exception as error:  # noqa: BLE001 - every query is reported
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok':5}{name:24}{time.time() - began:6.1f}s  {problem or ''}", flush=True)
    print(f"{bad} of {len(args.names or QUERIES)} differ")


if __name__ == "__main__":
    main()
