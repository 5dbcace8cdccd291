"""Compare each registered query with its SQL in DuckDB."""

from __future__ import annotations

import datetime as dt
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from rollbook.catalog.views import BASE  # noqa: E402
from rollbook.session import build_session  # noqa: E402

DATA = "/root/testdata"
TYPES = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
}


def connect(sf: str):
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/sf{sf}/{name}.parquet'")
    return con


def _value(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


def compare(spark, con, name: str, sf: str) -> str:
    """Empty when equal, else what differs."""
    df = entry.queries()[name](spark, f"{DATA}/sf{sf}")
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "" if rows else "no rows"
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    types = {d[0]: str(d[1]) for d in result.description}
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    wrong = {n: (k, types[n]) for n, k in df.dtypes if TYPES.get(k) != types[n]}
    if wrong:
        return f"types {wrong}"
    order = sorted(names)
    got = Counter(tuple(_value(r[n]) for n in order) for r in rows)
    at = [names.index(n) for n in order]
    want = Counter(tuple(_value(r[i]) for i in at) for r in expected)
    if got != want:
        return (
            f"{sum(got.values())} vs {sum(want.values())} rows; {order}; only spark {list((got - want).items())[:3]}; "
            f"only sql {list((want - got).items())[:3]}"
        )
    return "" if rows else "no rows"


if __name__ == "__main__":
    sf, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session(cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf), 0
    names = [n for n in entry.queries() if not wanted or any(n.startswith(w) for w in wanted)]
    for name in names:
        began = time.time()
        try:
            problem = compare(spark, con, name, sf)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += bool(problem)
        print(f"{'BAD ' if problem else 'ok  '}{name} {time.time() - began:.1f}s {problem}", flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")
    spark.stop()
