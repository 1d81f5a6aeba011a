"""Compare a registered query with its DuckDB statement: columns, types, rows as a bag."""

from __future__ import annotations

import decimal
import math
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

# Spark type -> DuckDB type.
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, decimal.Decimal):
        return float(value)
    return value


def bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_norm(row[i]) for i in order) for row in rows)


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    found = []
    types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    names = list(types)
    expected_rows = con.execute(sql).fetchall()
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} vs {sorted(names)}"]
    for name, dtype in df.dtypes:
        if TYPES.get(dtype) != types[name]:
            found.append(f"type of {name}: {dtype} vs {types[name]}")
    got = bag(df.columns, [tuple(r) for r in df.collect()])
    want = bag(names, expected_rows)
    if got != want:
        extra, lack = list((got - want).items())[:3], list((want - got).items())[:3]
        found.append(f"rows {sum(got.values())} vs {sum(want.values())}; only spark {extra}; only duckdb {lack}")
    if not want:
        found.append("no rows to compare")
    return found
