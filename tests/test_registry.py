"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from timeline_lake import catalog
from timeline_lake.catalog.check import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, catalog.queries()[name], catalog.oracle_sql()[name]) == ""
