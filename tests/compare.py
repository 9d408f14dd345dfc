"""Run registered queries against their DuckDB twins.

``python tests/compare.py [folder] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):  # noqa: ANN201
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads TO 8")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):  # noqa: ANN001, ANN201
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(value)
    return str(value)


def bag(columns: list[str], rows) -> list[tuple]:  # noqa: ANN001
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def difference(spark, con, folder: str, query, sql: str):  # noqa: ANN001, ANN201
    """None when both engines agree, else a short account."""
    df = query(spark, folder)
    mine = bag(df.columns, df.collect())
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    theirs = bag(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if mine == theirs:
        return None
    only_mine = [r for r in mine if r not in set(theirs)][:2]
    only_theirs = [r for r in theirs if r not in set(mine)][:2]
    return f"{len(mine)} against {len(theirs)} rows, columns {sorted(names)}; only here {only_mine}; only there {only_theirs}"


def main() -> int:
    import __spark_entry__ as entry
    from tarifflens import build_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]")
    con = connect(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args or list(queries):
        start = time.time()
        if name not in oracle:
            rows = queries[name](spark, folder).count()
            print(f"rows {rows:>7} {name} {time.time() - start:.1f}s (no SQL)", flush=True)
            continue
        try:
            problem = difference(spark, con, folder, queries[name], oracle[name])
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {name} {time.time() - start:.1f}s {problem or ''}"[:1800], flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
