"""Compare registered queries with their DuckDB SQL on the same tables."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns: list[str], rows) -> Counter:
    def plain(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 9) + 0.0
        if isinstance(x, (list, tuple)):
            return tuple(map(plain, x))
        return x

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(plain(row[k]) for k in order) for row in rows)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def compare(spark, name: str, run, sql: str, sf_dir: str) -> str:
    """An empty text if both agree, else what differs."""
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    kinds = {c: str(d[1]) for c, d in zip(columns, got.description)}
    want = rows_of(columns, got.fetchall())
    df = run(spark, sf_dir)
    have = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(columns)} and {sorted(df.columns)}"
    odd = [f"{c}: {k} and {kinds[c]}" for c, k in df.dtypes if KINDS.get(k, kinds[c]) != kinds[c]]
    if odd:
        return f"types: {odd}"
    if want != have:
        a, b = list((have - want).items())[:3], list((want - have).items())[:3]
        return f"{sum(have.values())} rows and {sum(want.values())}; only ours {a}; only the oracle's {b}"
    return ""
