"""Run queries beside their checking SQL and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from docweft.plans.derived import TABLES  # noqa: E402


def connect(folder: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return con


def canonical(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted("\x1f".join(canonical(r[i]) for i in order) for r in rows)


def check(spark, con, folder, name, query, sql):
    """None when equal, else a short text of the difference."""
    start = time.time()
    df = query(spark, folder)
    got_rows = [tuple(r) for r in df.collect()]
    spent = time.time() - start
    got = rows_of(df.columns, got_rows)
    if sql is None:
        return None, len(got), spent
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    want = rows_of(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}", len(got), spent
    if got == want:
        return None, len(got), spent
    only_got = [r for r in got if r not in set(want)][:3]
    only_want = [r for r in want if r not in set(got)][:3]
    text = f"{len(got)} rows against {len(want)}"
    for label, rows in (("spark", only_got), ("check", only_want)):
        for r in rows:
            text += f"\n   {label}: " + r.replace("\x1f", " | ")[:400]
    return text, len(got), spent


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from docweft.session import local_session

    spark = local_session()
    folder = f"/root/testdata/{sys.argv[1]}"
    con = connect(folder)
    wanted = sys.argv[2:]
    checks = oracle_sql()
    bad = 0
    for name, query in queries().items():
        if wanted and not any(name == w or name.startswith(w) for w in wanted):
            continue
        try:
            problem, count, spent = check(spark, con, folder, name, query, checks.get(name))
        except Exception as error:  # report and go on
            problem, count, spent = f"{type(error).__name__}: {str(error)[:700]}", 0, 0.0
        bad += problem is not None
        kind = "" if name in checks else " (no check)"
        print(f"{'ok ' if problem is None else 'BAD'} {name}{kind} {count} rows {spent:.2f}s", flush=True)
        if problem:
            print("   " + problem, flush=True)
    print("failures:", bad)
