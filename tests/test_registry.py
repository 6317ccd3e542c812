import pytest

from granary.plans import registry
from tests.compare import assert_same, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert_same(registry.QUERIES[name](spark, sf_dir), con, registry.ORACLES[name])
