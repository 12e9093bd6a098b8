"""Comparison of a query's rows with the rows of its SQL."""

import os

import duckdb


def same_rows(spark, query, sql: str, tables: str) -> None:
    got = query(spark, tables)
    con = duckdb.connect()
    for f in os.listdir(tables):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{tables}/{f}')")
    want = con.execute(sql)
    names = sorted(d[0] for d in want.description)
    assert sorted(got.columns) == names
    at = {d[0]: k for k, d in enumerate(want.description)}
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    rows = sorted((tuple(plain(r[at[n]]) for n in names) for r in want.fetchall()), key=str)
    assert sorted((tuple(plain(r[n]) for n in names) for r in got.collect()), key=str) == rows
