"""Run registered queries next to their SQL and compare them as bags of rows."""

from __future__ import annotations

import datetime
import glob
import os
from collections import Counter

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def _bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(spark_df, con: duckdb.DuckDBPyConnection, sql: str, show: int = 3) -> str | None:
    """None if both sides agree, else what differs."""
    rows = [tuple(r) for r in spark_df.collect()]
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    if sorted(columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(columns)}"
    ours, theirs = _bag(spark_df.columns, rows), _bag(columns, result.fetchall())
    if ours == theirs:
        return None
    only_ours, only_theirs = ours - theirs, theirs - ours
    return (
        f"{sorted(columns)}: {sum(only_ours.values())} rows only in Spark, e.g. "
        f"{list(only_ours)[:show]}; {sum(only_theirs.values())} only in SQL, e.g. "
        f"{list(only_theirs)[:show]}"
    )
