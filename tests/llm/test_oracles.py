import pytest

from nearfield.llm import queries
from tests.oracle import assert_equal_rows


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert_equal_rows(spark, queries.queries()[name], queries.oracle_sql()[name], "/root/testdata/sf0.01")
