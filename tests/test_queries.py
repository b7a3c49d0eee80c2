"""Every registered query against its oracle on the smallest tables."""

import os

import oracle
import pytest

import __spark_entry__ as contract

SF_DIR = os.environ.get("RUNQC_TEST_SF", "/root/testdata/sf0.001")
QUERIES = contract.queries()
ORACLES = contract.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in ORACLES:
        assert oracle.compare(df, con, ORACLES[name]) == []
    else:
        assert df.columns
        df.count()


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_oracles_name_only_known_queries():
    assert set(ORACLES) <= set(QUERIES)
