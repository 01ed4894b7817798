"""Every registered query against its SQL, or for rows where SQL cannot express it."""

import check
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return check.connect(FOLDER)


@pytest.mark.parametrize("key", [k for k in QUERIES if k in SQL])
def test_matches_sql(spark, con, key):
    assert check.compare(spark, con, FOLDER, key, QUERIES[key], SQL[key]) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
