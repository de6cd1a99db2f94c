"""Every registered query of the engine against its SQL."""

import pytest

from nearfield import queries
from tests.oracle import assert_equal_rows

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert_equal_rows(spark, queries.queries()[name], queries.oracle_sql()[name], SF)


def test_cell_recall_grows_with_the_rows_read(spark):
    rows = sorted(map(tuple, queries.ivf_recall(spark, SF).collect()))
    assert [r[0] for r in rows] == [2, 4, 8, 12] and rows[-1][2] > 0.9
    assert all(0 < a[1] < b[1] < 1 and a[2] <= b[2] for a, b in zip(rows, rows[1:], strict=False))
