"""The driver contract: every registered query against its SQL in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as contract

ROOT = "/root/testdata"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


@pytest.fixture(params=["sf0.001", "sf0.01", "sf0.1"])
def sf_dir(request):
    return f"{ROOT}/{request.param}"


@pytest.fixture
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    yield con
    con.close()


def ordered(names, rows):
    """Rows with their columns by name, sorted."""
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted([tuple(r[i] for i in order) for r in rows], key=repr)


def test_keys_match():
    own = {"nation_revenue", "nation_revenue_1998"}
    assert own <= contract.oracle_sql().keys() <= contract.queries().keys()


def test_entry(spark):
    df = contract.entry(spark)
    assert df.dtypes == [("n_name", "string"), ("revenue", "double"), ("n_lines", "bigint")]
    assert df.count() == 25


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = contract.queries()[name](spark, sf_dir)
    expected = duck.execute(contract.oracle_sql()[name])
    names = [c[0] for c in expected.description]
    assert sorted(df.columns) == sorted(names)
    got = ordered(df.columns, df.collect())
    assert got
    assert got == ordered(names, expected.fetchall())
