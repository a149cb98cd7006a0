"""Compare queries with their DuckDB SQL: ``python tests/oracle_check.py [sf] [name …]``."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}")
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str):
    """None when equal, else a short account of the difference."""
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    want = _rows(columns, result.fetchall())
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if want == got:
        kinds = {type(v).__name__ for row in got for v in row}
        return None if kinds <= {"int", "float", "str", "bool", "NoneType"} else f"kinds {kinds}"
    extra, missing = got - want, want - got
    return (f"{sum(got.values())} vs {sum(want.values())} rows; {sum(extra.values())} extra e.g. "
            f"{str(next(iter(extra), None))[:300]}; {sum(missing.values())} missing e.g. {str(next(iter(missing), None))[:300]}")


def main() -> None:
    from conftest import make_session

    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf = args[0] if args else "0.001"
    spark = make_session()
    sf_dir = f"/root/testdata/sf{sf}"
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in args[1:] or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            outcome = compare(df, con, oracles[name]) if name in oracles else f"rows {df.count()} (no SQL)"
        except Exception as e:  # noqa: BLE001
            outcome = f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{name:22s} {time.time() - start:6.1f}s {'ok' if outcome is None else outcome}", flush=True)


if __name__ == "__main__":
    main()
