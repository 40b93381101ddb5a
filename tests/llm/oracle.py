"""Compare a query with its SQL in DuckDB over the tables of a folder."""

import duckdb

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def same(spark_rows, sql, folder, digits=9):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.sql(sql)
    names = sorted(want.columns)
    keep = lambda v: round(v, digits) if isinstance(v, float) else v
    a = sorted(tuple(keep(r[c]) for c in names) for r in spark_rows)
    at = [want.columns.index(c) for c in names]
    b = sorted(tuple(keep(r[k]) for k in at) for r in want.fetchall())
    assert sorted(spark_rows[0].asDict()) == names
    for x, y in zip(a, b, strict=False):
        assert x == y
    assert len(a) == len(b)
