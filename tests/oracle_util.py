"""Order-insensitive comparison of a Spark result with a DuckDB query."""

from __future__ import annotations

import hashlib
import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

_CONS: dict[str, duckdb.DuckDBPyConnection] = {}


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    if sf_dir not in _CONS:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
        _CONS[sf_dir] = con
    return _CONS[sf_dir]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if hasattr(v, "asDict"):
        return _norm(list(v))
    return repr(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest(), lines


def compare(df, sql: str, sf_dir: str):
    rows = [tuple(r) for r in df.collect()]
    rel = connection(sf_dir).sql(sql)
    orows = rel.fetchall()
    h1, l1 = digest(df.columns, rows)
    h2, l2 = digest(rel.columns, orows)
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(rows) == len(orows)
    if h1 != h2:
        only_spark = [x for x in l1 if x not in set(l2)][:3]
        only_sql = [x for x in l2 if x not in set(l1)][:3]
        raise AssertionError(f"values differ\nspark: {only_spark}\nsql: {only_sql}")
