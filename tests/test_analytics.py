import pytest

from quillscan.plans import core
from tests.oracle import same_rows


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_rows_equal_the_sql(spark, tables, name):
    same_rows(spark, core.queries()[name], core.SQL[name], tables)


def test_every_sql_has_a_query():
    assert set(core.SQL) <= set(core.queries())
