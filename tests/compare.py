"""Run registered queries against their SQL in DuckDB and compare values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return repr(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = table([c[0] for c in cur.description], cur.fetchall())
    return got, want


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as e
    from tests.conftest import make_session

    sf = sys.argv[1]
    only = sys.argv[2:]
    spark, con = make_session(), duck(sf)
    sqls = e.oracle_sql()
    for name, query in e.queries().items():
        if only and name not in only:
            continue
        try:
            t = time.time()
            got, want = compare(spark, con, name, query, sqls[name], sf)
            ok = got == want
            print(f"{'ok  ' if ok else 'DIFF'} {name} rows={len(got[1])}/{len(want[1])} {time.time() - t:.2f}s", flush=True)
            if not ok:
                print("   cols", got[0], want[0])
                a, b = set(got[1]), set(want[1])
                print("   spark only", sorted(a - b)[:3])
                print("   duck only ", sorted(b - a)[:3])
        except Exception as ex:  # report and go on with the next query
            print("FAIL", name, type(ex).__name__, str(ex)[:600], flush=True)
