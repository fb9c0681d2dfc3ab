"""Compares a query with its SQL, row by row and without order."""

import math
import os

import duckdb


def plain(value):
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    return value


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(row[c]) for c in columns) for row in df.toArrow().to_pylist()), key=repr)


def sql_rows(sql, folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(folder):
        path = f"{folder}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    columns = sorted(names)
    return columns, sorted((tuple(plain(dict(zip(names, row))[c]) for c in columns) for row in result.fetchall()), key=repr)
