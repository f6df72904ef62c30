import pytest
from conftest import SF
from oracle import same

from marlstone.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    same(registry.QUERIES[name](spark, SF), registry.ORACLE_SQL[name], SF)


def test_every_query_has_sql_or_is_known():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
