"""Run registered queries against their DuckDB oracles.

    python -m tests.compare [sf_dir] [name-part ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return v if v is None or isinstance(v, (bool, str)) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(cell(r[i]) for i in order) for r in data]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple(str(x) for x in r))


def compare(df, con, sql: str):
    """None if equal, otherwise a short description of the difference."""
    got_cols, got = rows(df.columns, df.collect())
    cur = con.execute(sql)
    want_cols, want = rows([c[0] for c in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} <> {want_cols}", len(got)
    if got != want:
        a, b = set(got), set(want)
        return (f"rows {len(got)} <> {len(want)}; only spark {sorted(a - b, key=str)[:2]}; "
                f"only sql {sorted(b - a, key=str)[:2]}"), len(got)
    return None, len(got)


def main():
    from tests.session import session
    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = session()
    con = connect(folder)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if parts and not any(name == p or name.startswith(p) for p in parts):
            continue
        t = time.time()
        try:
            df = fn(spark, folder)
            if name in oracles:
                diff, n = compare(df, con, oracles[name])
            else:
                diff, n = None, len(df.collect())
            if n == 0:
                diff = diff or "EMPTY"
        except Exception as e:  # noqa: BLE001
            diff, n = f"{type(e).__name__}: {str(e)[:700]}", -1
        bad += diff is not None
        print(f"{'ok ' if diff is None else 'BAD'} {name:34s} rows={n:<8d} {time.time() - t:6.1f}s"
              f"{'' if name in oracles else ' (rows only)'} {'' if diff is None else diff[:1500]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
