"""Every registered query beside its checking SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import check, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    problem, _, _ = check(spark, con, FOLDER, name, queries()[name], oracle_sql().get(name))
    assert problem is None, problem


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) == 1 and rows[0]["total_links"] == rows[0]["valid_links"] + rows[0]["broken_links"]


def test_checks_name_known_queries():
    assert set(oracle_sql()) <= set(queries())
