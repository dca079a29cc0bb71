"""Runs SQL with DuckDB over the test tables and compares rows."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

DATA = Path("/root/testdata")


def plain(x):
    """A value without its engine's types; floats to 10 significant digits."""
    if isinstance(x, bool) or x is None or isinstance(x, (str, bytes)):
        return x
    if isinstance(x, (int, Decimal)):
        return float(x) if isinstance(x, Decimal) and x != int(x) else int(x)
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.10g}")
    if isinstance(x, (datetime, date)):
        return x.isoformat()
    if isinstance(x, dict):
        return tuple(plain(v) for v in x.values())
    return tuple(plain(v) for v in x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df):
    return sorted(df.columns), rows_of(df.columns, df.collect())


def duck_rows(sql, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for p in Path(sf_dir).glob("*.parquet"):
        files = f"{p}/*.parquet" if p.is_dir() else p
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{files}')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return sorted(names), rows_of(names, got.fetchall())


def same(df, sql, sf_dir):
    a, b = spark_rows(df), duck_rows(sql, sf_dir)
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    wrong = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    assert not wrong, wrong[:3]
