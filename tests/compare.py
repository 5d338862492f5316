"""Runs a query in Spark and its SQL in DuckDB and compares rows, in no order."""

from decimal import Decimal
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, (float, Decimal)):
        return float(f"{float(v):.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def same(spark, query, sql: str, sf_dir: str) -> None:
    got = query(spark, sf_dir)
    cols = sorted(got.columns)
    mine = sorted(repr(plain(tuple(r[c] for c in cols))) for r in got.collect())
    with duckdb.connect() as c:
        c.execute("SET TimeZone = 'UTC'")
        for p in Path(sf_dir).glob("*.parquet"):
            c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
        r = c.execute(sql)
        names = [d[0] for d in r.description]
        assert sorted(names) == cols
        theirs = sorted(repr(plain(tuple(dict(zip(names, x, strict=True))[k] for k in cols))) for x in r.fetchall())
    assert len(mine) == len(theirs)
    assert mine == theirs
