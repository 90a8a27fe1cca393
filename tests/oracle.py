"""Compare a query with its SQL on the same tables."""

import duckdb

from palimpsest.session import TABLES

SF = "/root/testdata/sf0.001"


def plain(value):
    return float(f"{value:.9g}") if isinstance(value, float) else value


def rows_of(rows):
    key = lambda r: tuple((v is None, str(v)) for v in r)
    return sorted((tuple(map(plain, r)) for r in rows), key=key)


def check(spark, query, sql, sf=SF):
    db = duckdb.connect()
    db.sql("set timezone = 'UTC'")
    for name in TABLES:
        db.sql(f"create view {name} as from read_parquet('{sf}/{name}.parquet')")
    found = query(spark, sf)
    names = sorted(found.columns)
    assert names == sorted(db.sql(sql).columns)
    listed = ", ".join(f'"{n}"' for n in names)
    assert rows_of(found.select(*[f"`{n}`" for n in names]).collect()) == rows_of(db.sql(f"select {listed} from ({sql})").fetchall())
