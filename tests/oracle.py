"""Run registered queries and their SQL twins side by side: python tests/oracle.py [folder] [name…]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, bool):
        return value
    if hasattr(value, "item"):
        return plain(value.item())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return names, sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if not isinstance(v, (tuple,)) else str(v)) for v in r))


def compare(spark, con, name, build, sql, folder):
    """Empty string when equal, else what differs."""
    frame = build(spark, folder)
    got_names, got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if sql is None:
        return "" if got else "no rows"
    result = con.execute(sql)
    want_names, want = rows_of([d[0] for d in result.description], result.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2] if len(got) < 50000 else []
        missing = [r for r in want if r not in set(got)][:2] if len(got) < 50000 else []
        return f"rows {len(got)} != {len(want)}; extra {extra}; missing {missing}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first:\n   spark {bad[0][0]}\n   sql   {bad[0][1]}"
    types = [(n, type(a), type(b)) for n, a, b in zip(got_names, got[0], want[0]) if type(a) is not type(b)] if got else []
    return f"types {types}" if types else ""


def main():
    from __spark_entry__ import oracle_sql, queries
    from corpusloom.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:]
    spark = local_session()
    con = connect(folder)
    sqls = oracle_sql()
    failed = []
    for name, build in queries().items():
        if names and name not in names and not any(n.endswith("*") and name.startswith(n[:-1]) for n in names):
            continue
        begun = time.time()
        try:
            problem = compare(spark, con, name, build, sqls.get(name), folder)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{'ok ' if not problem else 'BAD'} {name} {time.time() - begun:.1f}s {problem}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
