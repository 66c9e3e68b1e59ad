"""Every registered query against its SQL statement on the small tables."""

import pytest
from oracle_check import actual_rows, connect, expected_rows

from wakeline.plans.catalog import QUERIES, registered
from wakeline.plans.oracles import oracle_sql


@pytest.fixture(scope="module")
def database(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, sf_dir, database, name):
    got = actual_rows(registered()[name](spark, sf_dir))
    want = expected_rows(database, oracle_sql()[name])
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert got[1]
