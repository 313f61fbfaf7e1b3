import pytest
from onomast.plans import catalog

from tests.oracle import difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_against_sql(spark, name):
    assert difference(spark, catalog.QUERIES[name], catalog.SQL[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
