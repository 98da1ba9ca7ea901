"""Compare registered queries with their SQL oracles: python tests/oracle_check.py [sf] [names...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

from millrace.sources.schemas import TABLES

DATA = "/root/testdata"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if hasattr(value, "item"):
        return _plain(value.item())
    if isinstance(value, bool):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def _key(row):
    return tuple(
        (0, "") if v is None else (1, f"{v + 0.0:.5g}") if isinstance(v, float) else (2, str(v)) for v in row
    )


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, [tuple(_plain(r[n]) for n in names) for r in df.collect()]


def rows_of_duck(con, sql):
    result = con.execute(sql)
    order = [d[0] for d in result.description]
    names = sorted(order)
    at = [order.index(n) for n in names]
    return names, [tuple(_plain(r[i]) for i in at) for r in result.fetchall()]


def difference(names, got, want, tolerance=0.0):
    """None when equal, else a short text. Exact by default."""
    if len(got) != len(want):
        return f"row count {len(got)} != {len(want)}"
    got, want = sorted(got, key=_key), sorted(want, key=_key)
    bad = 0
    first = None
    for a, b in zip(got, want):
        for n, x, y in zip(names, a, b):
            same = x == y
            if not same and isinstance(x, (int, float)) and isinstance(y, (int, float)):
                same = abs(x - y) <= tolerance * max(1.0, abs(x), abs(y))
            if not same:
                bad += 1
                first = first or f"{n}: {x!r} != {y!r} | {a} | {b}"
                break
    return f"{bad} of {len(got)} rows differ, first {first}" if bad else None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from millrace.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    wanted = sys.argv[2:]
    folder = f"{DATA}/sf{sf}"
    spark = build_session(
        master="local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sqls = oracle_sql()
    failed = []
    for name, run in queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            names, got = rows_of_spark(run(spark, folder))
            took = time.time() - start
            if name not in sqls:
                print(f"rows  {name:36s} {len(got):8d} rows {took:6.2f}s", flush=True)
                continue
            start = time.time()
            other, want = rows_of_duck(con, sqls[name])
            duck = time.time() - start
            fault = f"columns {names} != {other}" if names != other else difference(names, got, want)
        except Exception as error:  # report and go on
            took, duck, got, fault = time.time() - start, 0.0, [], f"{type(error).__name__}: {str(error)[:900]}"
        if fault:
            failed.append(name)
        print(f"{'FAIL' if fault else 'ok':5s} {name:36s} {len(got):8d} rows {took:6.2f}s duck {duck:5.2f}s {fault or ''}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
