"""Side-by-side run of a registered query and its SQL in DuckDB."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, con, query, sql: str, sf_dir: str) -> tuple[int, list[str]]:
    """Row count and a list of differences, empty when both sides agree."""
    df = query(spark, sf_dir)
    got_columns, got = df.columns, [tuple(r) for r in df.collect()]
    result = con.execute(sql)
    want_columns = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(got_columns) != sorted(want_columns):
        return len(got), [f"columns {sorted(got_columns)} != {sorted(want_columns)}"]
    mine, theirs = rows_of(got_columns, got), rows_of(want_columns, want)
    out = []
    if mine != theirs:
        extra, lacking = list((mine - theirs))[:2], list((theirs - mine))[:2]
        out = [f"rows {len(got)} / {len(want)}", f"only spark {extra}", f"only sql {lacking}", str(sorted(got_columns))]
    return len(got), out
