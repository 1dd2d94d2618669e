"""Every query with SQL gives the same rows in Spark and in DuckDB."""

import pytest
from oracle import expected, found

from tidemark import catalog

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert found(catalog.queries()[name](spark, SF)) == expected(catalog.oracle_sql()[name], SF)
