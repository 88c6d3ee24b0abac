"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from spillway import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(registry.queries())


def norm(v):
    if v is None or isinstance(v, float) and v != v:
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6))
    return str(v)


def rows(t):
    names = sorted(t.column_names)
    return names, sorted(tuple(norm(r[c]) for c in names) for r in t.to_pylist())


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(registry.oracle_sql()) == set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, sf_dir, name):
    got = registry.queries()[name](spark, sf_dir).toArrow()
    expected = duck.sql(registry.oracle_sql()[name]).to_arrow_table()
    assert rows(got) == rows(expected)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(NAMES) <= set(e.queries())


def test_membership_filters_hold_every_query(spark, sf_dir):
    got = registry.queries()["membership_all_found"](spark, sf_dir).toPandas()
    never = got["item"].str.contains(" never.", regex=False)
    assert got["found"][~never].all() and (~never).sum() > 0
    assert never.sum() > 0 and got["found"][never].mean() < 0.02
