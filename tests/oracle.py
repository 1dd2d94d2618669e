"""Spark results against DuckDB, as rows with sorted columns."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    return x if isinstance(x, (int, str, bool, type(None))) else str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(cell(r[i]) for i in order) for r in data), key=str)


def expected(sql, sf_dir):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    got = con.sql(sql)
    return rows([d[0] for d in got.description], got.fetchall())


def found(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])
