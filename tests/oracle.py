"""Run registered queries and their SQL side by side: python tests/oracle.py [sf dir] [query ...]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from partlens.plans.tables import GIVEN  # noqa: E402


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in GIVEN:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int):
        return repr(float(value)) if abs(value) < 2**53 else str(value)
    if hasattr(value, "as_tuple"):
        return repr(float(value))
    return str(value)


def table(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, con, sf: str, name: str) -> str | None:
    """None when both sides agree, else what differs."""
    df = entry.queries()[name](spark, sf)
    mine = table(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if mine else "no rows"
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    theirs = table(columns, result.fetchall())
    if mine == theirs:
        return None if mine else "both empty"
    a, b = set(mine), set(theirs)
    return f"{len(mine)} rows vs {len(theirs)}; only Spark {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}"


def main() -> None:
    from partlens.session import get_spark

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = get_spark("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    for name in names:
        start = time.time()
        try:
            told = compare(spark, con, sf, name)
        except Exception as error:  # noqa: BLE001
            told = "ERROR " + str(error)[:600]
        mark = "ok  " if told is None else "FAIL"
        kind = "" if name in entry.oracle_sql() else " (rows only)"
        print(f"{mark} {name}{kind} {time.time() - start:.1f}s {told or ''}", flush=True)


if __name__ == "__main__":
    main()
