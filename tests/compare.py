"""Run registered queries against DuckDB: python tests/compare.py [--sf 0.01] [name ...]"""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def oracle_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return names, cursor.fetchall()


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(repr(tuple(row[i] for i in order)) for row in rows)


def difference(df, sql: str, sf_dir: str) -> str | None:
    """None when equal, else a short account of the difference."""
    got = [tuple(r) for r in df.collect()]
    names, left = normal(df.columns, got)
    oracle_names, right = normal(*oracle_rows(sql, sf_dir))
    if names != oracle_names:
        return f"columns {names} != {oracle_names}"
    if left == right:
        return None
    extra, missing = list((left - right).items())[:2], list((right - left).items())[:2]
    return (
        f"rows {sum(left.values())} vs {sum(right.values())}, "
        f"{sum((left - right).values())} differ\n   ours   {extra}\n   oracle {missing}"
    )


def main(argv):
    from __spark_entry__ import oracle_sql, queries

    from blockloom.session import build_session

    sf = "0.01"
    if "--sf" in argv:
        at = argv.index("--sf")
        sf = argv[at + 1]
        del argv[at : at + 2]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        "compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs, oracles = queries(), oracle_sql()
    names = [n for n in runs if not argv or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in argv)]
    bad = []
    for name in names:
        started = time.time()
        try:
            df = runs[name](spark, sf_dir)
            if name in oracles:
                problem = difference(df, oracles[name], sf_dir)
            else:
                problem = None if df.count() > 0 else "no rows"
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        took = time.time() - started
        mark = "O" if name in oracles else "R"
        print(f"{'ok  ' if problem is None else 'BAD '} {mark} {took:6.2f}s {name}" + (f"\n   {problem}" if problem else ""), flush=True)
        if problem:
            bad.append(name)
    print(f"{len(names) - len(bad)}/{len(names)} ok; bad: {bad}")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
