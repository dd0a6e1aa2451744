"""Run a query and its SQL side by side and compare names, types and values."""

from __future__ import annotations

import glob
import math
import os
import time
from collections import Counter

import duckdb

FAMILY = {
    "byte": "int", "short": "int", "integer": "int", "long": "bigint", "tinyint": "int",
    "smallint": "int", "double": "double", "float": "float", "boolean": "boolean",
    "string": "varchar", "timestamp_ntz": "timestamp", "date": "date",
}
DUCK = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "FLOAT": "float",
        "BOOLEAN": "boolean", "VARCHAR": "varchar", "TIMESTAMP": "timestamp", "DATE": "date"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return repr(v)


def compare(spark, con, build, sql, sf_dir) -> tuple[str, int, float]:
    """('' or what differs, rows, seconds of the Spark side)."""
    start = time.time()
    df = build(spark, sf_dir)
    names = sorted(df.columns)
    rows = [tuple(_value(r[n]) for n in names) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return "" if rows else "no rows", len(rows), took
    relation = con.sql(sql)
    if sorted(relation.columns) != names:
        return f"columns {names} != {sorted(relation.columns)}", len(rows), took
    types = dict(zip(relation.columns, [DUCK.get(str(t), str(t)) for t in relation.types]))
    for f in df.schema.fields:
        mine = FAMILY.get(f.dataType.typeName(), f.dataType.simpleString())
        if mine != types[f.name]:
            return f"type of {f.name}: {mine} != {types[f.name]}", len(rows), took
    order = [relation.columns.index(n) for n in names]
    theirs = [tuple(_value(r[i]) for i in order) for r in relation.fetchall()]
    a, b = Counter(rows), Counter(theirs)
    if a == b:
        return "", len(rows), took
    return (
        f"{len(rows)} rows != {len(theirs)}; only here {list((a - b).items())[:2]}; "
        f"only there {list((b - a).items())[:2]}",
        len(rows), took,
    )
