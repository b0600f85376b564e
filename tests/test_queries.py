"""Every registered query against DuckDB on a small folder of tables."""

import os

import pytest
from compare import expected, rows_of

from statloom.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    got = rows_of(registry.QUERIES[name](spark, FOLDER).toPandas())
    if name in registry.SQL:
        want = expected(registry.SQL[name], FOLDER)
        assert got[0] == want[0]
        assert len(got[1]) == len(want[1])
        assert got[1] == want[1]
    else:
        assert got[1]
