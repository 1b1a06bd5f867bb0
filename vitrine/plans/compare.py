"""Compare a Spark result with a DuckDB oracle result: same column names, same
multiset of rows (order-insensitive), values normalised for type spelling."""

from __future__ import annotations

import decimal
import math

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return str(v.normalize())
    return str(v)


def canonical(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return [columns[i] for i in order], sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def diff(spark_df, con, sql: str) -> str | None:
    """None when equal, else a short description of the difference."""
    s_cols, s_rows = canonical(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    d_cols, d_rows = canonical([c[0] for c in cur.description], cur.fetchall())
    if s_cols != d_cols:
        return f"columns spark={s_cols} oracle={d_cols}"
    if s_rows != d_rows:
        a, b = set(s_rows), set(d_rows)
        return (f"rows spark={len(s_rows)} oracle={len(d_rows)} spark-only={sorted(a - b, key=str)[:3]} "
                f"oracle-only={sorted(b - a, key=str)[:3]}")
    return None
