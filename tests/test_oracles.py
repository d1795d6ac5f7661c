"""Every registered query of the reference's operators against its SQL, on the smallest tables."""

import pytest
from oracle import compare, connect
from stayline import catalog

SF = "/root/testdata/sf0.001"
#: Queries that find nothing on the smallest tables, and are right to.
WITHOUT_ROWS: set[str] = set()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    problem = compare(catalog.QUERIES[name](spark, SF), catalog.ORACLE_SQL[name], con)
    assert problem == ("no rows" if name in WITHOUT_ROWS else None), problem


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert df.columns and df.limit(1).count() == 1
