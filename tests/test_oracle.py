"""Every registered query against its DuckDB equivalent on the smallest test data."""

import pytest

from check import compare, connect
from courtside.plans import catalog

PATH = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(PATH)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    rows, expected, verdict, _ = compare(spark, con, name, PATH)
    assert verdict in ("ok", "rows only"), verdict
