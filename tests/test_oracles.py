"""Every registered query against its DuckDB SQL, at the smallest size."""

import pytest

from broadsheet.plans import catalogue
from tests.compare import difference, duck
from tests.conftest import SF


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, con, name):
    assert difference(catalogue.QUERIES[name](spark, SF), con, catalogue.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_runs(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    assert len(df.columns) > 1 and df.count() >= 0
