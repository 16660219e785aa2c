"""Runs queries beside their SQL twins: python tests/compare.py [--sf DIR] NAME..."""

from __future__ import annotations

import math
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return [_norm(x) for x in v]
    if isinstance(v, dict):
        return {k: _norm(x) for k, x in v.items()}
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    if isinstance(v, bool) or v is None:
        return v
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr([_norm(r[i]) for i in order]) for r in rows)), [columns[i] for i in order]


def oracle_rows(sql: str, sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if p.is_file() else f'{p}/*.parquet'}'")
    out = con.execute(sql)
    return rows_of([d[0] for d in out.description], out.fetchall())


def spark_rows(df):
    return rows_of(df.columns, [list(r.asDict(True).values()) if len(set(df.columns)) == len(df.columns) else list(r) for r in df.collect()])


if __name__ == "__main__":
    import time

    from conftest import session

    import __spark_entry__ as e

    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    spark = session()
    qs, sqls = e.queries(), e.oracle_sql()
    for name in args or qs:
        t = time.time()
        try:
            got, cols = spark_rows(qs[name](spark, sf))
            took = time.time() - t
            if name not in sqls:
                print(f"{name}: {len(got)} rows, no SQL, {took:.1f} s", flush=True)
                continue
            want, wcols = oracle_rows(sqls[name], sf)
            same = got == want and cols == wcols
            print(f"{name}: {'same' if same else 'DIFFERENT'} {len(got)} {len(want)} rows, {took:.1f} s", flush=True)
            if not same:
                print("  columns", cols, wcols)
                g, w = set(got), set(want)
                print("  only spark", sorted(g - w)[:3], len(g - w), "\n  only sql", sorted(w - g)[:3], len(w - g))
        except Exception as x:
            print(f"{name}: FAILED {type(x).__name__} {str(x)[:1500]}", flush=True)
