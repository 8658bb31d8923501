"""Order-insensitive comparison of a Spark result with DuckDB's."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    for f in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    made = [tuple(plain(r[i]) for i in order) for r in data]
    return sorted(made, key=lambda r: tuple((x is not None, str(type(x)), x) if x is not None else (False, "", "") for x in r))


def spark_rows(df):
    return sorted(df.columns), rows(df.columns, df.collect())


def duck_rows(con, sql):
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    return sorted(columns), rows(columns, found.fetchall())
