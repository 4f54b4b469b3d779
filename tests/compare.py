"""Spark's rows against DuckDB's for the registered queries."""

import math

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(row):
    return tuple((x is None, str(type(x)) if x is None else "", round(x, 5) if isinstance(x, float) else x) for x in row)


def differences(df, sql: str, con) -> str:
    """What differs between a DataFrame and SQL; empty if nothing does."""
    got, cur = df.collect(), con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {df.columns} and {names}"
    a = sorted((tuple(r[c] for c in sorted(names)) for r in got), key=_key)
    at = [names.index(c) for c in sorted(names)]
    b = sorted((tuple(r[k] for k in at) for r in cur.fetchall()), key=_key)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    for x, y in zip(a, b):
        for p, q in zip(x, y):
            same = p == q or (isinstance(p, float) and isinstance(q, float) and (math.isclose(p, q, rel_tol=1e-9, abs_tol=1e-9) or (math.isnan(p) and math.isnan(q))))
            if not same or type(p) is not type(q):
                return f"{x} and {y}"
    return ""
