"""Every registered query against its SQL oracle at the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    if name in ORACLES:
        diff, _ = compare(df, con, ORACLES[name])
        assert diff is None, diff
    else:
        assert df.columns
        df.collect()


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert "target_section" in df.columns
    assert df.limit(1).count() == 1
