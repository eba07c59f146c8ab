"""Every query with a DuckDB twin gives the twin's rows."""

import pytest

from tests.oracle import compare, duck
from wayfold import queries as own

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_oracle(spark, con, name):
    assert compare(spark, con, own.queries()[name], own.oracle_sql()[name], SF) == ""
