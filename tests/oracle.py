"""Compares a query's rows with those of its SQL in DuckDB."""

import datetime
import decimal
import glob
import os


def plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6f}"
    if isinstance(v, datetime.date) and not isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v) if not isinstance(v, (int, bytes)) else v


def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def compare(df, connection, sql):
    """Asserts equal columns and, in any order, equal rows; returns how many."""
    r = connection.execute(sql)
    names, theirs = [d[0] for d in r.description], r.fetchall()
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    a = sorted((tuple(plain(row[c]) for c in order) for row in df.collect()), key=repr)
    at = [names.index(c) for c in order]
    b = sorted((tuple(plain(row[i]) for i in at) for row in theirs), key=repr)
    assert a == b
    return len(a)
