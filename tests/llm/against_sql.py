"""Queries of the text folder next to their SQL: python -m tests.llm.against_sql [sf] [name ...]"""

import sys
import time


from quire.llm.queries import ORACLES, QUERIES
from tests.oracle import DATA, duck


def difference(spark, con, name: str, sf_dir: str) -> str:
    ours = QUERIES[name](spark, sf_dir).toArrow()
    theirs = con.execute(ORACLES[name]).to_arrow_table()
    names = sorted(ours.column_names)
    if names != sorted(theirs.column_names):
        return f"columns {names} != {sorted(theirs.column_names)}"
    if ours.num_rows != theirs.num_rows:
        return f"rows {ours.num_rows} != {theirs.num_rows}"
    kinds = [(n, a, b) for n in names if (a := str(ours.schema.field(n).type)) != (b := str(theirs.schema.field(n).type))]
    key = lambda row: tuple((v is not None, v) for v in row)
    both = [sorted(zip(*[t.column(n).to_pylist() for n in names]), key=key) for t in (ours, theirs)]
    wrong = [(x, y) for x, y in zip(*both) if x != y]
    return f"{len(wrong)} rows differ, first {names}: {wrong[0]}" if wrong else f"types {kinds}" if kinds else ""


def main() -> None:
    from quire.session import local_session

    spark = local_session(4, memory="4g")
    sf = str(DATA / sys.argv[1])
    for name in sys.argv[2:] or QUERIES:
        start = time.time()
        if name in ORACLES:
            print(name, difference(spark, duck(sf), name, sf) or "ok", round(time.time() - start, 1), flush=True)
        else:
            df = QUERIES[name](spark, sf)
            print(name, df.count(), "rows only", round(time.time() - start, 1), flush=True)
            df.show(6, 120)


if __name__ == "__main__":
    main()
