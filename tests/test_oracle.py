"""Every query of the reference's operators against its DuckDB statement (exact value
hash). The training-data queries have their own tests."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL
from tests.oracle_util import compare, duck
from tierspark.plans import registry

SQL = entry.oracle_sql()
NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_sql():
    assert set(NAMES) <= set(SQL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF_SMALL)
    compare(df, con, SQL[name])


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert df.columns[:2] == ["centroid_id", "category"]
