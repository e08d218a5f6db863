"""Every registered query against its comparison text on the smallest tables."""

import pytest
from check import compare, connect

from cuewright.plans import load_queries

FOLDER = "/root/testdata/sf0.001"
QUERIES = load_queries()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    q = QUERIES[name]
    ok, note = compare(spark, con, name, q.run, q.sql, FOLDER)
    assert ok, note
