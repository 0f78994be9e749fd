"""Every registered query with SQL gives the rows of its SQL on the given tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tools.check_queries import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["event_source", "n", "n_anomaly", "rate"] and df.count() > 0


def test_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    ok, note = compare(spark, duck, SF, name)
    assert ok is not False, note
