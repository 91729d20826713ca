"""Run registered queries next to their SQL twins. ``python tests/compare.py [sf] [name ...]``"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def differences(spark, con, sf_dir, fn, sql):
    """Empty string when both sides agree, else the first difference."""
    df = fn(spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = canonical(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(got)
    if len(got) != len(want):
        only = [r for r in got if r not in set(want)][:2]
        miss = [r for r in want if r not in set(got)][:2]
        return f"rows {len(got)} != {len(want)}; extra {only}; missing {miss}", len(got)
    for a, b in zip(got, want):
        if a != b:
            return f"got {a}\n   want {b}", len(got)
    return "", len(got)


def main(argv):
    import __spark_entry__ as entry
    from scanflow.session import build_session

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    wanted = argv[1:]
    spark, con = build_session("8"), duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        begin = time.time()
        try:
            if name in oracles:
                diff, n = differences(spark, con, sf_dir, fn, oracles[name])
            else:
                diff, n = "", len(fn(spark, sf_dir).collect())
        except Exception as error:  # noqa: BLE001
            diff, n = f"ERROR {str(error)[:700]}", -1
        mark = "ok " if not diff else "BAD"
        bad += bool(diff)
        note = "" if name in oracles else " (rows only)"
        print(f"{mark} {name:34s} {n:7d} {time.time() - begin:6.2f}s{note} {diff}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
