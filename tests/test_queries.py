"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import pytest
from oracle import connect, difference

import workload

workload.load()
D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(D).exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(D)


@pytest.mark.parametrize("name", sorted(workload.SQL))
def test_equals_sql(spark, con, name):
    assert difference(workload.QUERIES[name](spark, D), con, workload.SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(workload.QUERIES) - set(workload.SQL)))
def test_gives_rows(spark, name):
    assert not workload.QUERIES[name](spark, D).isEmpty()
