"""Runs a named query beside its SQL and compares rows, column types and values."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}" if v else "0"
    if isinstance(v, bool):
        return str(v)
    return repr(v)


def _kind(t) -> str:
    text = str(t).replace("large_", "")
    return "timestamp" if text.startswith("timestamp") else text


def compare(spark, con, query, sql, sf_dir) -> list[str]:
    """Differences between the Spark result and the SQL result; empty when they agree."""
    ours = query(spark, sf_dir).toArrow()
    theirs = con.sql(sql).to_arrow_table()
    problems = []
    names, expected = sorted(ours.column_names), sorted(theirs.column_names)
    if names != expected:
        return [f"columns {names} != {expected}"]
    for name in names:
        a, b = _kind(ours.schema.field(name).type), _kind(theirs.schema.field(name).type)
        if a != b:
            problems.append(f"type of {name}: {a} != {b}")
    if ours.num_rows != theirs.num_rows:
        problems.append(f"rows {ours.num_rows} != {theirs.num_rows}")
    rows = lambda t: sorted(tuple(map(_cell, r)) for r in zip(*[t.column(n).to_pylist() for n in names]))
    left, right = rows(ours), rows(theirs)
    if left != right:
        only = [r for r in left if r not in set(right)][:2]
        miss = [r for r in right if r not in set(left)][:2]
        problems.append(f"values over {names}:\n   spark only {only}\n   sql only   {miss}")
    if ours.num_rows == 0:
        problems.append("no rows at all")
    return problems
