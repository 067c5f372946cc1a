"""Every registered query against its SQL statement on the smallest tables."""

import compare
import pytest

from diegrid.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(catalog.QUERIES))
def test_query(spark, key):
    assert compare.difference(spark, compare.connect(SF), catalog.QUERIES[key], catalog.SQL.get(key), SF) is None
