"""Compare every registered query with its SQL twin: python tests/check_oracles.py [sf_dir] [query ...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

import __spark_entry__ as entry
from flowlens.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, int):
        return f"{float(v):.9g}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf, name, fn, sql):
    start = time.time()
    df = fn(spark, sf)
    ours = rows_of(df.columns, df.collect())
    spent = time.time() - start
    if sql is None:
        return f"ROWS  {name} rows={len(ours)} {spent:.1f}s"
    cur = con.cursor()
    cur.execute(sql)
    columns = [d[0] for d in cur.description]
    theirs = rows_of(columns, cur.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"FAIL  {name} columns {sorted(df.columns)} / {sorted(columns)}"
    if ours == theirs:
        return f"OK    {name} rows={len(ours)} {spent:.1f}s oracle {time.time() - start - spent:.1f}s"
    mine, other = set(ours) - set(theirs), set(theirs) - set(ours)
    return f"FAIL  {name} rows {len(ours)}/{len(theirs)} only ours {sorted(mine)[:2]} only oracle {sorted(other)[:2]}"


def main(sf, only):
    spark = local_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    oracle = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        try:
            print(compare(spark, con, sf, name, fn, oracle.get(name)), flush=True)
        except Exception as exc:
            print(f"ERROR {name} {type(exc).__name__} {str(exc)[:700]}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001", sys.argv[2:])
