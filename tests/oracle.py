"""Run registered queries next to their SQL on DuckDB and compare every value.

    python -m tests.oracle [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

import duckdb

from quire.plans import registry

DATA = Path("/root/testdata")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is not None, str(type(v)), v) if not isinstance(v, bool) else (True, "b", v) for v in row)


def _rows(table, names: list[str]) -> list[tuple]:
    cols = [table.column(n).to_pylist() for n in names]
    return sorted(zip(*cols), key=_key)


def compare(spark, con, name: str, sf_dir: str) -> str:
    """Empty when the query and its SQL agree, else what differs."""
    ours = registry.QUERIES[name](spark, sf_dir).toArrow()
    if name not in registry.ORACLES:
        return "" if ours.num_rows else "no rows"
    theirs = con.execute(registry.ORACLES[name]).to_arrow_table()
    a, b = sorted(ours.column_names), sorted(theirs.column_names)
    if a != b:
        return f"columns {a} != {b}"
    types = [
        (n, str(ours.schema.field(n).type), str(theirs.schema.field(n).type))
        for n in a
        if str(ours.schema.field(n).type).replace("large_", "")
        != str(theirs.schema.field(n).type).replace("large_", "")
    ]
    if ours.num_rows != theirs.num_rows:
        return f"rows {ours.num_rows} != {theirs.num_rows} {types}"
    if ours.num_rows == 0:
        return "both empty"
    for x, y in zip(_rows(ours, a), _rows(theirs, a)):
        if x != y:
            return f"first difference {a}\n      ours {x}\n      sql  {y} {types}"
    return f"types {types}" if types else ""


def main() -> int:
    from quire.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    registry.load()
    spark = local_session(8)
    sf_dir = str(DATA / f"sf{args.sf}")
    con = duck(sf_dir)
    bad = 0
    for name in args.names or registry.QUERIES:
        start = time.time()
        try:
            problem = compare(spark, con, name, sf_dir)
        except Exception as exc:  # report and go on with the next query
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += bool(problem)
        mark = "ok  " if not problem else "FAIL"
        kind = "" if name in registry.ORACLES else " (rows only)"
        print(f"{mark} {time.time() - start:6.2f}s {name}{kind} {problem}", flush=True)
    print(f"{bad} of {len(args.names or registry.QUERIES)} differ")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
