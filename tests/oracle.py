"""Holds queries against their DuckDB statements: python tests/oracle.py SF NAME..."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

DATA = os.environ.get("TEST_DATA", "/root/testdata")


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for p in sorted(Path(DATA, sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*' if p.is_dir() else ''}')")
    con.execute("SET TimeZone = 'UTC'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if hasattr(v, "as_tuple"):
        return round(float(v), 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    if hasattr(v, "asDict"):
        return tuple((k, plain(x)) for k, x in v.asDict().items())
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> str:
    """'' if the rows are the same, else what differs."""
    mine = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    theirs = rows_of([c[0] for c in cur.description], cur.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} and {theirs[0]}"
    if mine[1] != theirs[1]:
        return f"{sum(mine[1].values())} and {sum(theirs[1].values())} rows; only here {list((mine[1] - theirs[1]).elements())[:3]}; only there {list((theirs[1] - mine[1]).elements())[:3]}"
    return "" if mine[1] else "no rows"


def main(sf: str, names: list[str]) -> int:
    import __spark_entry__ as e
    from querymill.session import local_session

    spark, con, bad = local_session(8), duck(sf), 0
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracle = e.queries(), e.oracle_sql()
    for n in names or queries:
        for name in [x for x in queries if x == n or (n.endswith("*") and x.startswith(n[:-1]))]:
            began = time.time()
            try:
                if name in oracle:
                    said = compare(queries[name](spark, f"{DATA}/{sf}"), con, oracle[name])
                else:
                    said = f"rows only: {queries[name](spark, f'{DATA}/{sf}').count()}"
            except Exception as x:  # noqa: BLE001
                said = f"{type(x).__name__}: {str(x)[:400]}"
            bad += bool(said) and not said.startswith("rows only")
            print(f"{name}: {said or 'same'} ({time.time() - began:.1f} s)", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
