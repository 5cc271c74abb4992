"""Compare query results with the checking SQL, row by row."""

from __future__ import annotations

import decimal
import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, float) and value == 0:
        return 0.0
    if hasattr(value, "tzinfo") and getattr(value, "tzinfo", None) is not None:
        return value.replace(tzinfo=None)
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(plain, key=repr)


def _close(a, b):
    if type(a) is float or type(b) is float:
        if a is None or b is None or isinstance(a, str) or isinstance(b, str):
            return a == b
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def differences(df, con, sql: str, limit: int = 5) -> list[str]:
    """Empty when both give the same rows and columns."""
    relation = con.execute(sql)
    sql_columns = [c[0] for c in relation.description]
    expected = _rows(sql_columns, relation.fetchall())
    actual = _rows(df.columns, [tuple(row) for row in df.collect()])
    found = []
    if sorted(df.columns) != sorted(sql_columns):
        return [f"columns {sorted(df.columns)} != {sorted(sql_columns)}"]
    if len(actual) != len(expected):
        found.append(f"rows {len(actual)} != {len(expected)}")
    exact = 0
    for a, e in zip(actual, expected):
        if a == e:
            exact += 1
        elif not all(map(_close, a, e)):
            found.append(f"{a} != {e}")
            if len(found) >= limit:
                break
    if not found and exact != len(expected):
        found.append(f"only {exact} of {len(expected)} rows exactly equal")
    return found
