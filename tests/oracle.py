"""Compare a query with its SQL in DuckDB over the same tables."""

import math
import os

import duckdb
from onomast.plans.views import NAMES


def connection(sf_dir):
    c = duckdb.connect()
    for t in NAMES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=str)


def difference(spark, query, sql, sf_dir, c=None):
    """"" if both give the same columns, types and rows, else what differs."""
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = (c or connection(sf_dir)).execute(sql)
    names = [d[0] for d in found.description]
    kinds = {d[0]: str(d[1]).lower() for d in found.description}
    theirs = rows_of(names, found.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    same = {"bigint": "bigint", "int": "integer", "string": "varchar", "double": "double", "boolean": "boolean"}
    for name, kind in df.dtypes:
        if same.get(kind, kind) != kinds[name]:
            return f"types of {name}: {kind} and {kinds[name]}"
    if mine != theirs:
        only = [r for r in mine if r not in theirs][:3], [r for r in theirs if r not in mine][:3]
        return f"{len(mine)} and {len(theirs)} rows; only here {only[0]}, only there {only[1]}"
    return "" if mine else "no rows"
