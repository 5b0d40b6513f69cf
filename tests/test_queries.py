"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
from compare import compare_query, duck
from conftest import SF

# queries of training-data operators have tests of their own
QUERIES = {n: q for n, q in entry.queries().items() if not n.startswith("op") and n != "pipeline"}
ORACLE = {n: s for n, s in entry.oracle_sql().items() if n in QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() == 3 and out.columns[0] == "split"


def test_names():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    verdict = compare_query(spark, con, SF, QUERIES[name], ORACLE.get(name))
    assert verdict.startswith("ok"), verdict
