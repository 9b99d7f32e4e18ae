"""Every registered query of the core against DuckDB on the smallest tables; those without SQL must run and give rows."""

import pytest

from axisloom import catalogue
from tests.compare import difference, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, connection, name):
    assert difference(catalogue.QUERIES[name](spark, SF), connection, catalogue.ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", ["state_frequency", "decoded_restart"])
def test_query_without_sql_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry_and_registry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalogue.QUERIES) <= set(e.queries())
