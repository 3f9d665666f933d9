"""Compare a registered query with its SQL twin, row by row."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{Path(sf_dir) / (name + '.parquet')}'")
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else (round(value, 7) + 0.0)
    if isinstance(value, int):
        return float(value) if abs(value) < 2**53 else value
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    out = [tuple(_cell(r[k]) for k in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v) for v in r))


def compare(df, sql: str, con) -> tuple[bool, str]:
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    expected = _rows(names, result.fetchall())
    actual = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(actual) != len(expected):
        return False, f"{len(actual)} rows != {len(expected)}"
    for a, e in zip(actual, expected):
        if a != e:
            return False, f"first difference: {a} != {e}"
    return True, f"{len(actual)} rows"
