"""Every registered query of the core against its SQL twin."""

import pytest

from presswork.plans import registry

from . import oracle

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    sql = registry.oracle_sql().get(name)
    if sql:
        oracle.compare(spark, con, FOLDER, registry.queries()[name], sql)
    else:
        assert registry.queries()[name](spark, FOLDER).collect()
