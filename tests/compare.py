"""Run a named query on Spark and its SQL on DuckDB and compare the two results as bags of rows."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import os

import duckdb


def value(v):
    if isinstance(v, (dt.datetime,)):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return tuple(value(x) for x in v)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return v
    return v


def connection(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf_dir: str, plan, sql: str):
    frame = plan(spark, sf_dir)
    ours = bag(frame.columns, [tuple(r) for r in frame.collect()])
    rel = connection(sf_dir).execute(sql)
    columns = [d[0] for d in rel.description]
    theirs = bag(columns, rel.fetchall())
    problems = []
    if sorted(columns) != sorted(frame.columns):
        problems.append(f"columns {sorted(frame.columns)} != {sorted(columns)}")
    if ours != theirs:
        only_ours = [r for r in ours if r not in set(theirs)][:3] if len(ours) < 200000 else []
        only_theirs = [r for r in theirs if r not in set(ours)][:3]
        problems.append(f"rows {len(ours)} vs {len(theirs)}; ours only {only_ours}; sql only {only_theirs}")
    return problems, len(ours)
