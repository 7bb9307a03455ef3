"""Query against SQL, as the driver does it: same columns, same types, same rows."""

from __future__ import annotations

import math
import os

import duckdb


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        connection.sql(f"create view {name.removesuffix('.parquet')} as from '{sf_dir}/{name}'")
    return connection


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted((tuple(normal(v) for v in r) for r in df.select(*names).collect()), key=repr)


def rows_of_duckdb(relation):
    names = sorted(relation.columns)
    order = [relation.columns.index(n) for n in names]
    return names, sorted((tuple(normal(r[i]) for i in order) for r in relation.fetchall()), key=repr)


SAME_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "float": "FLOAT",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def type_differences(df, relation):
    theirs = dict(zip(relation.columns, (str(t) for t in relation.types)))
    return [(n, t, theirs.get(n)) for n, t in df.dtypes if SAME_TYPES.get(t) != theirs.get(n)]
