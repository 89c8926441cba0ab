"""Holds a query's rows against those of its SQL."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.10g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def order(row):
    return [(x is None, str(x)) for x in row]


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=order)


def rows_of_sql(con, sql):
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    names = sorted(columns)
    return names, sorted((tuple(plain(r[columns.index(n)]) for n in names) for r in found.fetchall()), key=order)


def same(df, con, sql):
    assert rows_of(df) == rows_of_sql(con, sql)
