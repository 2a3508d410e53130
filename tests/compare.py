"""Run every registered query beside its SQL and compare the rows.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = [tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows]
    return sorted(columns), sorted(clean, key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


def compare(spark, con, name, query, sql, sf_dir):
    """None when equal, else what differs."""
    df = query(spark, sf_dir)
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    columns, want = rows_of(names, cursor.fetchall())
    if got_columns != columns:
        return f"columns {got_columns} and {columns}"
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}; first {got[:2]} and {want[:2]}"
    for a, b in zip(got, want):
        if a != b:
            return f"{a} and {b}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from conftest import make_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = make_session(), connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or queries:
        begun = time.time()
        try:
            if name in sqls:
                result = compare(spark, con, name, queries[name], sqls[name], sf_dir)
            else:
                result = f"rows only: {queries[name](spark, sf_dir).count()}"
        except Exception as e:
            result = f"{type(e).__name__}: {str(e)[:400]}"
        bad += result is not None and not result.startswith("rows only")
        print(f"{name:28s} {time.time() - begun:6.2f}s  {result or 'equal'}", flush=True)
    print("differing:", bad)
