"""A query against its SQL on the same parquet files."""

import glob
import os

import duckdb


def view_names(sf):
    return [os.path.basename(p)[:-8] for p in glob.glob(f"{sf}/*.parquet")]


def oracle(sql, sf):
    con = duckdb.connect()
    for name in view_names(sf):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return names, got.fetchall()


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(x):
        if isinstance(x, bool) or x is None:
            return repr(x)
        if isinstance(x, float):
            return repr(round(x, 6) + 0.0)
        return repr(x)

    return [sorted(names), sorted(tuple(cell(r[i]) for i in order) for r in rows)]


def check(spark, query, sql, sf):
    df = query(spark, sf)
    left = canonical(df.columns, [tuple(r) for r in df.collect()])
    right = canonical(*oracle(sql, sf))
    assert left[0] == right[0]
    assert len(left[1]) == len(right[1])
    assert left[1] == right[1]
