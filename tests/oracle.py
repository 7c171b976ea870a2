"""Run a query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb


def connect(folder: str):
    db = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        db.execute(f"create view {name} as select * from read_parquet('{path}')")
    return db


def _text(value) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return repr(value) if isinstance(value, float) else str(value)


def rows_of(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_text(r[i]) for i in order) for r in rows)


def compare(df, db, sql: str) -> str | None:
    """None if equal, else what differs."""
    got_columns = list(df.columns)
    got = rows_of(got_columns, [tuple(r) for r in df.collect()])
    db.execute(sql)
    want_columns = [d[0] for d in db.description]
    want = rows_of(want_columns, db.fetchall())
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} != {sorted(want_columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows, SQL has {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, columns {sorted(got_columns)}: first {bad[0]}"
    if not got:
        return "no rows"
    return None
