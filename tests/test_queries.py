"""Every registered query equals its SQL on DuckDB."""

import pytest

import __spark_entry__ as contract
from check_oracles import compare, database
from sessionlake.plans.oracles import ORACLES
from sessionlake.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return database(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    problem, _ = compare(spark, duck, SF_DIR, name)
    assert problem is None


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries())


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0
