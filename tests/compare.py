"""Run queries beside their check SQL: ``python tests/compare.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


def _key(row):
    return tuple((x is not None, type(x).__name__, x if x is not None else 0) for x in row)


def difference(df, con, sql: str) -> str | None:
    """None if both give the same rows, else a short account of the difference."""
    theirs = con.execute(sql)
    names = [d[0] for d in theirs.description]
    kinds = [str(d[1]) for d in theirs.description]
    want = theirs.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    expect = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    types = dict(df.dtypes)
    wrong = [(n, types[n], k) for n, k in zip(names, kinds) if expect.get(k, k) != types[n]]
    got = [tuple(_plain(x) for x in r) for r in df.select(*names).collect()]
    want = [tuple(_plain(x) for x in r) for r in want]
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    got.sort(key=_key)
    want.sort(key=_key)
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[:2]}"
    return f"types {wrong}" if wrong else None


def main():
    import __spark_entry__ as entry
    from wavemill.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session(8)
    con = connect(sf_dir)
    checks = entry.oracle_sql()
    failed = 0
    for name, f in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = f(spark, sf_dir)
            if name in checks:
                df = df.cache()
                df.count()
                took = time.time() - start
                said = difference(df, con, checks[name])
                df.unpersist()
            else:
                n = df.count()
                took = time.time() - start
                said = None if n else "no rows"
                name += f" (rows only: {n})"
        except Exception as e:
            took, said = time.time() - start, f"{type(e).__name__}: {str(e)[:700]}"
        failed += said is not None
        print(f"{'ok  ' if said is None else 'FAIL'} {took:6.2f}s {name}  {said or ''}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
