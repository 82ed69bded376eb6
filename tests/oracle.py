"""A query's rows against its SQL's, by DuckDB, whatever their order."""

import glob
import os

import duckdb


def views(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return str(v) if hasattr(v, "isoformat") else v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in values), key=str)


def check(spark, run, sql, sf_dir):
    got = run(spark, sf_dir)
    cur = views(sf_dir).execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, cur.fetchall())
