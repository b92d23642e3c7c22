import pytest

from lexengine.plans import catalogue, replays  # noqa: F401 (adds its queries)

from oracle import compare, connect


@pytest.fixture(scope="module")
def db(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows_as_sql(spark, db, sf, name):
    compare(spark, db, sf, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)
