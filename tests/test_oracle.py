"""Every registered query against its SQL on the smallest data set."""

import pytest

import __spark_entry__ as entry_point
from compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
# Conditions that no row of the smallest data set meets.
NO_ROWS = {"key_rotation_due", "key_versions_to_disable"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry_point.queries()))
def test_query(spark, con, name):
    sql = entry_point.oracle_sql().get(name)
    found = difference(spark, con, FOLDER, entry_point.queries()[name], sql)
    assert found == ("both empty" if name in NO_ROWS else None)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
