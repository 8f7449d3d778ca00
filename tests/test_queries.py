"""Every registered query against its SQL on the smallest sample."""

import pytest

import __spark_entry__ as entry
from tests.compare import difference, duck

FOLDER = "/root/testdata/sf0.001"
QUERIES, CHECKS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    mine = QUERIES[name](spark, FOLDER).toPandas()
    if name in CHECKS:
        assert difference(mine, con.execute(CHECKS[name]).df()) is None
    else:
        assert len(mine)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
