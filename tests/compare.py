"""Run registered queries and their SQL on the same tables and compare the results."""

from __future__ import annotations

import math
import time

import duckdb

from gradus.checks.bindings import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return ("nan",)
        return float(f"{value:.9g}") + 0.0
    return value


def _kind(value):
    if isinstance(value, bool):
        return "bool"
    return {int: "int", float: "float"}.get(type(value), type(value).__name__)


def compare(spark, con, name: str, query, sql: str, folder: str) -> tuple[str | None, int, float, float]:
    """(problem or None, rows, Spark seconds, SQL seconds)."""
    start = time.time()
    df = query(spark, folder)
    got = [tuple(r) for r in df.collect()]
    spark_time, start = time.time() - start, time.time()
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    sql_time = time.time() - start
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(got), spark_time, sql_time
    order = sorted(names)
    types = {c[0]: TYPES.get(str(c[1]), str(c[1])) for c in cursor.description}
    wrong = {c: (t, types[c]) for c, t in df.dtypes if types[c] != t}
    if wrong:
        return f"types {wrong}", len(got), spark_time, sql_time
    a = [tuple(_plain(r[df.columns.index(c)]) for c in order) for r in got]
    b = [tuple(_plain(r[names.index(c)]) for c in order) for r in want]
    if len(a) != len(b):
        return f"{len(a)} rows, SQL has {len(b)}", len(got), spark_time, sql_time
    a, b = sorted(a, key=repr), sorted(b, key=repr)
    for x, y in zip(a, b):
        if x != y or [_kind(v) for v in x] != [_kind(v) for v in y]:
            return f"first difference {dict(zip(order, x))} != {dict(zip(order, y))}", len(got), spark_time, sql_time
    return None, len(got), spark_time, sql_time
