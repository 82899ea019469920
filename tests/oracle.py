"""Compare a query with its SQL on DuckDB: sorted column names, order-free rows."""

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v)
    return str(pd.Timestamp(v)) if hasattr(v, "year") else str(v)


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(tuple(cell(r[n]) for n in names) for r in table.to_pylist())


def compare(con, df, sql):
    mine, theirs = rows(df.toArrow()), rows(con.sql(sql).to_arrow_table())
    assert mine[0] == theirs[0]
    assert len(mine[1]) == len(theirs[1])
    assert mine[1] == theirs[1]
