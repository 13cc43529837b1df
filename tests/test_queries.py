"""Each registered query gives what its SQL gives; those without SQL give rows."""

import pytest

from lorefold.plans import registry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_has_rows(name, spark):
    assert not registry.QUERIES[name](spark, SMALL).isEmpty()


def test_every_sql_has_its_query():
    assert set(registry.SQL) <= set(registry.QUERIES)
