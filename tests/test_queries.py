"""Every query with SQL against DuckDB over the same tables; the others must run."""

import duckdb
import pytest

from lumenframe.queries import EVERY, EVERY_ORACLE, ORACLES, QUERIES, TABLELESS

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def _plain(v):
    return v if v is None or isinstance(v, (str, bool, int)) else float(v)


@pytest.mark.parametrize("name", sorted(EVERY_ORACLE))
def test_equal_to_sql(spark, duck, name):
    rows = EVERY[name](spark, FOLDER)
    names = sorted(rows.columns)
    want = duck.sql(EVERY_ORACLE[name])
    assert sorted(want.columns) == names
    key = lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r)
    a = sorted((tuple(_plain(r[c]) for c in names) for r in rows.collect()), key=key)
    b = sorted((tuple(_plain(r[want.columns.index(c)]) for c in names) for r in want.fetchall()), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y, abs=1e-9)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_registered_queries_read_tables(spark, tmp_path):
    """Without the tables each registered query fails, and those left out don't."""
    for name, f in QUERIES.items():
        with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
            f(spark, str(tmp_path)).count()
    assert set(EVERY) == set(QUERIES) | TABLELESS and set(ORACLES) == set(EVERY_ORACLE) - TABLELESS
