"""Run Spark queries and their SQL twins side by side and compare all rows."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def sql_engine(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, bool):
        return str(v)
    return repr(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, con, name, query, sql, sf_dir):
    """Raises AssertionError on the first difference; returns (rows, spark seconds, sql seconds)."""
    t0 = time.time()
    df = query(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    assert got_cols == want_cols, f"{name}: columns {got_cols} != {want_cols}"
    assert len(got) == len(want), f"{name}: {len(got)} rows != {len(want)}"
    for g, w in zip(got, want, strict=True):
        assert g == w, f"{name}:\n spark {g}\n sql   {w}\n columns {got_cols}"
    return len(got), t1 - t0, t2 - t1
