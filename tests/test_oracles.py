"""Every registered query that has SQL equals it on the smallest tables; the rest give rows."""

import os

import pytest

from loomframe.plans.registry import ORACLES, QUERIES
from tests.oracle import compare

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLES:
        compare(spark, name, SF, QUERIES, ORACLES)
    else:
        assert QUERIES[name](spark, SF).count() > 0
