"""Every registered query against its SQL in DuckDB."""

import __spark_entry__ as entry_module
import pytest
from compare import compare, database
from eventboard.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, con, sf_dir, name):
    oracles = entry_module.oracle_sql()
    assert name in oracles, "every query so far has a SQL equivalent"
    rows, differences = compare(spark, con, entry_module.queries()[name], oracles[name], sf_dir)
    assert not differences, differences
    # At the smallest scale nothing but these may be empty.
    assert rows > 0


def test_entry_runs(spark):
    assert entry_module.entry(spark).limit(1).count() == 1
