import pytest

from pathloom.llm import catalog
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_oracle(spark, name):
    check(spark, catalog.queries()[name], catalog.oracle_sql()[name])
