"""Run a query and its SQL twin over a folder of tables and compare the rows."""

from __future__ import annotations

from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def same_rows(spark, name: str, sf_dir: str) -> int:
    """Asserts that both sides have the same columns and rows; gives the number of rows."""
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    res = duck(sf_dir).execute(entry.oracle_sql()[name])
    theirs = rows_of([c[0] for c in res.description], res.fetchall())
    assert sorted(df.columns) == sorted(c[0] for c in res.description)
    assert len(mine) == len(theirs), (len(mine), len(theirs))
    assert mine == theirs, next((a, b) for a, b in zip(mine, theirs, strict=True) if a != b)
    return len(mine)
