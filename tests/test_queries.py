"""Each query over the driver's small tables against its DuckDB SQL."""

import os

import pytest
from compare import same

from fallline.plans.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ORACLES)
def test_query(spark, name):
    same(spark, QUERIES[name], ORACLES[name], SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
