"""Compare a registered query with its SQL, row by row."""

from __future__ import annotations

import math
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows),
        key=lambda r: tuple((v is not None, str(v)) for v in r),
    )


def compare(spark, con, name, fn, sql, sf_dir):
    """(rows, seconds, difference or None)."""
    start = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return len(got), took, None
    result = con.sql(sql)
    want_cols, want = result.columns, result.fetchall()
    if sorted(df.columns) != sorted(want_cols):
        return len(got), took, f"columns {sorted(df.columns)} != {sorted(want_cols)}"
    a, b = _rows(df.columns, got), _rows(want_cols, want)
    if a == b:
        return len(got), took, None
    extra, missing = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return len(got), took, f"{len(a)} rows vs {len(b)}; only spark {extra}; only sql {missing}"
