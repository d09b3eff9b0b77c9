"""Every registered query of the map operators against its DuckDB oracle; the others for rows."""

import pytest
from compare import assert_same, database

from geoloom.plans import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(small_dir):
    return database(small_dir)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, small_dir, con, name):
    assert_same(QUERIES[name](spark, small_dir), con, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, small_dir, name):
    df = QUERIES[name](spark, small_dir)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
