"""Every registered query against its SQL on the small tables."""

import pytest

import __spark_entry__ as driver
from oracle_compare import connect, differences

QUERIES, SQL = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(n for n in SQL if not n.startswith("op")))
def test_query_matches_sql(spark, sf, duck, name):
    assert differences(QUERIES[name](spark, sf), duck, SQL[name]) is None


def test_every_query_of_its_own_has_sql():
    own = {n for n in QUERIES if n != "pipeline" and not n.startswith("op")}
    assert own == {n for n in SQL if not n.startswith("op")}


def test_entry_counts_labels(spark):
    rows = driver.entry(spark).collect()
    assert sum(r.events for r in rows) == 1000
