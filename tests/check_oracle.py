"""Compare registered queries with their DuckDB twins.

Usage: python tests/check_oracle.py [folder] [name ...]
"""

from __future__ import annotations

import logging
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return repr(value)
    return str(value)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = sorted(tuple(str(canonical(r[i])) for i in order) for r in rows)
    return [columns[i] for i in order], body


def compare(df, con, sql):
    """None when equal, else a short description of the difference."""
    kinds = dict(df.dtypes)
    mine = table_of(df.columns, [tuple(r) for r in df.collect()])
    relation = con.sql(sql)
    theirs = table_of(relation.columns, relation.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} vs {theirs[0]}"
    family = lambda t: "int" if any(k in t.lower() for k in ("int", "long")) else "float" if any(k in t.lower() for k in ("double", "float", "decimal")) else t.lower()
    for name, kind in zip(relation.columns, relation.types):
        if str(kind) == "HUGEINT":
            return f"column {name} is HUGEINT in SQL"
        width = {"bigint": "BIGINT", "int": "INTEGER"}.get(kinds[name])
        if {family(kinds[name]), family(str(kind))} == {"int", "float"} or (width and str(kind) != width) or "DECIMAL" in str(kind):
            return f"column {name}: {kinds[name]} vs {kind}"
    if mine[1] != theirs[1]:
        only_mine = [r for r in mine[1] if r not in set(theirs[1])][:2]
        only_theirs = [r for r in theirs[1] if r not in set(mine[1])][:2]
        return f"{len(mine[1])} vs {len(theirs[1])} rows; only spark {only_mine}; only sql {only_theirs}"
    return None


def main(argv):
    from newsloom import catalog
    from newsloom.session import build

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    logging.getLogger("DataFrameQueryContextLogger").setLevel(logging.CRITICAL)
    spark = build("local[8]", 8)
    con = connect(folder)
    queries, oracle = catalog.queries(), catalog.oracle_sql()
    bad = 0
    for name in argv[1:] or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            problem = compare(df, con, oracle[name]) if name in oracle else None
            n = con.sql(f"SELECT count(*) FROM ({oracle[name]})").fetchall()[0][0] if name in oracle else df.count()
        except Exception as error:  # report and go on with the next query
            problem, n = f"{type(error).__name__}: {str(error)[:300]}", -1
        bad += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name:38s} {n:7d} rows {time.time() - start:6.2f}s {'' if name in oracle else '(rows only)'} {problem or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
