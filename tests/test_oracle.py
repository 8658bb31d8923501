"""Every registered query against its SQL."""

import compare
import pytest
from conftest import FOLDER

import __spark_entry__ as entry
from tabsieve.checks.oracle import ORACLE
from tabsieve.checks.queries import QUERIES


@pytest.fixture(scope="module")
def duck():
    con = compare.connect(FOLDER)
    yield con
    con.close()


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 8


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    columns, rows = compare.spark_rows(entry.queries()[name](spark, FOLDER))
    wanted_columns, wanted = compare.duck_rows(duck, entry.oracle_sql()[name])
    assert columns == wanted_columns
    assert len(rows) == len(wanted) and len(rows) > 0
    assert rows == wanted
