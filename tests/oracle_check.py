"""Compare a Spark plan with its DuckDB oracle: row count, column names and
an order-insensitive multiset of rows (floats compared after repr)."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(float(v))
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v if v is None else str(v) if not isinstance(v, (int, bool)) else int(v)


def rows_of_spark(df) -> tuple[list[str], list[tuple]]:
    cols = df.columns
    return cols, [tuple(_norm(r[c]) for c in cols) for r in df.collect()]


def rows_of_duck(con, sql) -> tuple[list[str], list[tuple]]:
    rel = con.sql(sql)
    cols = rel.columns
    return cols, [tuple(_norm(x) for x in r) for r in rel.fetchall()]


def compare(spark_df, con, sql) -> tuple[bool, str]:
    sc, sr = rows_of_spark(spark_df)
    dc, dr = rows_of_duck(con, sql)
    if sorted(sc) != sorted(dc):
        return False, f"columns differ: spark={sc} duck={dc}"
    order = [dc.index(c) for c in sc]
    dr = [tuple(r[i] for i in order) for r in dr]
    if len(sr) != len(dr):
        return False, f"row count spark={len(sr)} duck={len(dr)}"
    key = lambda r: tuple((x is None, "" if x is None else str(x)) for x in r)
    ss, ds = sorted(sr, key=key), sorted(dr, key=key)
    bad = [(a, b) for a, b in zip(ss, ds) if a != b]
    if bad:
        return False, f"{len(bad)} rows differ, e.g. spark={bad[0][0]} duck={bad[0][1]}"
    return True, f"{len(sr)} rows match"
