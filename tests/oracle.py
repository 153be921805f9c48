"""Run a registered query and its SQL on the same tables and compare all values."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(body, key=lambda r: tuple((x is None, str(type(x)), x) if x is not None else (True, "", 0) for x in r))


def kinds(types):
    def kind(t):
        t = str(t).lower()
        if t.startswith("decimal"):
            return "decimal"
        return {"bigint": "int64", "integer": "int32", "int": "int32", "varchar": "string",
                "timestamp_ntz": "timestamp", "timestamp with time zone": "timestamp"}.get(t, t)
    return {c: kind(t) for c, t in types}


def compare(df, con, sql) -> list[str]:
    """Differences as texts; none means the results are the same."""
    got_cols, got = table(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want_cols, want = table(names, cursor.fetchall())
    problems = []
    if got_cols != want_cols:
        return [f"columns {sorted(set(got_cols) ^ set(want_cols))}"]
    types = con.execute(f"DESCRIBE {sql}").fetchall()
    a, b = kinds(df.dtypes), kinds([(r[0], r[1]) for r in types])
    problems += [f"type of {c}: {a[c]} against {b[c]}" for c in a if a[c] != b[c]]
    if len(got) != len(want):
        problems.append(f"rows {len(got)} against {len(want)}")
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    if wrong:
        g, w = wrong[0]
        where = [(c, x, y) for c, x, y in zip(got_cols, g, w) if x != y]
        problems.append(f"{len(wrong)} rows differ, first {where[:4]}")
    return problems
