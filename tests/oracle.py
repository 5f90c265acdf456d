"""Compares a query with its SQL on the same tables."""

import os

import duckdb
import numpy as np


def plain(v):
    if isinstance(v, (list, np.ndarray)):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    return v


def rows_of(table):
    names = sorted(table.column_names)
    return names, sorted(repr([plain(r[c]) for c in names]) for r in table.to_pylist())


def connect(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def assert_same(df, con, sql):
    assert rows_of(df.toArrow()) == rows_of(con.sql(sql).to_arrow_table())
