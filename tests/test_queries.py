"""Every registered query against its oracle."""

import pytest

from tests import oracle
from tessera.plans import composed, feeds, registry, workloads  # noqa: F401  the others register their queries in registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    if name in registry.ORACLE_SQL:
        assert oracle.compare(spark, con, registry.QUERIES[name], registry.ORACLE_SQL[name], SF) is None
    else:
        assert registry.QUERIES[name](spark, SF).count() > 0
