"""Every registered query of the library's own operators against its SQL."""

import os

import pytest
from oracle import compare

from tidemark.plans import catalog

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, name):
    assert name in ORACLES
    assert compare(spark, name, QUERIES[name], ORACLES[name], SF) == ""
