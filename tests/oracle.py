"""Compare a Spark result with DuckDB SQL on the same Parquet files."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

DATA = "/root/testdata"


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def plain(x):
    """A value in a form that both engines share."""
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.10g}")
    if isinstance(x, decimal.Decimal):
        return float(f"{float(x):.10g}")
    if isinstance(x, (datetime.datetime, datetime.date)):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return x


def rows(names: list[str], found) -> tuple[list[str], list[list]]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(([plain(r[k]) for k in order] for r in found), key=repr)


def difference(df, sql: str, sf_dir: str) -> str:
    """Empty if both give the same rows, else what differs first."""
    result = tables(sf_dir).execute(sql)
    want_names, want = rows([d[0] for d in result.description], result.fetchall())
    names, got = rows(df.columns, df.collect())
    if names != want_names:
        return f"columns {names} instead of {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows instead of {len(want)}; e.g. {[r for r in got if r not in want][:2]} / {[r for r in want if r not in got][:2]}"
    for a, b in zip(got, want):
        if a != b:
            return f"{a} instead of {b} ({names})"
    return ""
