"""Runs a query and its DuckDB text over the same tables and compares the rows as multisets."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or str(v) in ("nan", "<NA>", "NaT", "None"):
        return "~"
    if isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
        return str(bool(v))
    try:
        return str(round(float(v), 6)) if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def rows(frame) -> tuple[list[str], list[tuple]]:
    cols = sorted(frame.columns)
    return cols, sorted(tuple(map(cell, r)) for r in frame[cols].itertuples(index=False, name=None))


def check(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = rows(df.toPandas()), rows(con.execute(sql).df())
    assert got[0] == want[0]
    assert got[1] == want[1]
