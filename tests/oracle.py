"""Runs a query on Spark and its SQL on DuckDB and compares schema and rows."""

from __future__ import annotations

import datetime
import decimal
import math
import time

import duckdb

from lakeaccord.sources.lake import TABLES

TYPE_NAMES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def compare(spark, folder: str, run, sql: str | None) -> dict:
    """Empty ``problem`` means equal column names, types, row counts and values."""
    started = time.time()
    frame = run(spark, folder)
    spark_rows = frame.collect()
    result = {"seconds": round(time.time() - started, 2), "rows": len(spark_rows), "problem": ""}
    if sql is None:
        return result
    started = time.time()
    relation = connect(folder).sql(sql)
    names, types = list(relation.columns), [str(t) for t in relation.types]
    duck_rows = relation.fetchall()
    result["sql_seconds"] = round(time.time() - started, 2)
    if sorted(names) != sorted(frame.columns):
        result["problem"] = f"columns {sorted(frame.columns)} against {sorted(names)}"
        return result
    declared = {n: TYPE_NAMES.get(t, t) for n, t in frame.dtypes}
    wrong = {n: (declared[n], t) for n, t in zip(names, types) if declared[n] != t}
    if wrong:
        result["problem"] = f"types {wrong}; "
    left, right = _rows(spark_rows, frame.columns), _rows(duck_rows, names)
    if len(left) != len(right):
        result["problem"] += f"row counts {len(left)} against {len(right)}"
    else:
        differing = [(a, b) for a, b in zip(left, right) if a != b]
        if differing:
            a, b = differing[0]
            first = [(n, x, y) for n, x, y in zip(sorted(names), a, b) if x != y]
            result["problem"] += f"{len(differing)} rows differ, first: {str(first)[:600]}"
    return result
