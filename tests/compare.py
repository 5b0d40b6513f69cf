"""Run a query on Spark and its SQL on DuckDB and compare rows without regard to order."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        if math.isnan(value):
            return None
        return round(value, 5) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    return value


def kind(value):
    return type(value).__name__


# Spark type → DuckDB types that hold the same values
TYPES = {"bigint": {"BIGINT"}, "int": {"INTEGER"}, "tinyint": {"TINYINT"}, "double": {"DOUBLE"}, "float": {"FLOAT"},
         "string": {"VARCHAR"}, "boolean": {"BOOLEAN"}, "timestamp_ntz": {"TIMESTAMP"}}


def same_type(spark_type: str, duck_type: str) -> bool:
    return duck_type in TYPES.get(spark_type, {duck_type})


def rows_of(records, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


def compare_query(spark, con, sf_dir, function, sql) -> str:
    df = function(spark, sf_dir)
    names = df.columns
    records = [tuple(r) for r in df.collect()]
    if sql is None:
        return f"ok rows-only {len(records)}" if records else "EMPTY (rows-only)"
    cursor = con.execute(sql)
    duck_names = [d[0] for d in cursor.description]
    if sorted(duck_names) != sorted(names):
        return f"COLUMNS spark={sorted(names)} duck={sorted(duck_names)}"
    left = rows_of(records, names)
    right = rows_of(cursor.fetchall(), duck_names)
    if len(left) != len(right):
        return f"ROWS spark={len(left)} duck={len(right)}\n   spark {left[:2]}\n   duck  {right[:2]}"
    order = sorted(names)
    for a, b in zip(left, right):
        if a != b:
            where = [(order[i], x, y) for i, (x, y) in enumerate(zip(a, b)) if x != y or kind(x) != kind(y)]
            differing = sum(x != y for x, y in zip(left, right))
            return f"VALUES {differing}/{len(left)} differ; first {where}\n   spark {a}\n   duck  {b}"
    for a, b in zip(left, right):
        for i, (x, y) in enumerate(zip(a, b)):
            if x is not None and y is not None and kind(x) != kind(y):
                return f"TYPES {order[i]} spark={kind(x)} duck={kind(y)}"
    if not left:
        return "EMPTY"
    duck_types = {d[0]: str(d[1]).upper() for d in cursor.description}
    odd = [f"{f.name}:{f.dataType.simpleString()}/{duck_types[f.name]}" for f in df.schema.fields
           if not same_type(f.dataType.simpleString(), duck_types[f.name])]
    if odd:
        return f"TYPES {odd}"
    return f"ok {len(left)}"
