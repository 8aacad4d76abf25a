"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
import compare
from custodia.plans import load_all

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="shared tables are not here")


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


def test_every_query_has_sql_and_no_sql_is_left_over():
    assert set(load_all().ORACLES) == set(load_all().QUERIES)
    assert set(load_all().QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(load_all().QUERIES))
def test_query_equals_sql(spark, con, name):
    got = compare.spark_rows(entry.queries()[name](spark, SF_DIR))
    assert got == compare.sql_rows(con, entry.oracle_sql()[name])


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "user_prompt" in df.columns
