"""Every registered query against its SQL check, on whole tables of the smallest size."""

import pytest

import __spark_entry__ as entry
from tests.oracle import check_rows, connect, spark_rows

SF_DIR = "/root/testdata/sf0.001"
QUERIES, CHECKS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    names, rows = spark_rows(QUERIES[name](spark, SF_DIR))
    assert rows, "a query must return rows"
    if name in CHECKS:
        expected_names, expected = check_rows(con, CHECKS[name])
        assert names == expected_names
        assert rows == expected


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 20 and all(0 <= r["score"] <= 100 for r in rows)
