"""Every registered query against its SQL on the smallest tables, and invariants of the ones without SQL."""

import os

import pytest

import __spark_entry__ as spark_entry
import check

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
ORACLES = spark_entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", sorted(spark_entry.queries()))
def test_query_matches_sql(spark, con, name):
    ok, detail, _, _ = check.compare(spark, con, name, spark_entry.queries()[name], ORACLES.get(name), SF)
    assert ok, detail



def test_entry_has_rows(spark):
    assert spark_entry.entry(spark).columns == ["doc_id", "score"]
