import pytest

from shareflow.plans.queries import ORACLES, QUERIES
from tests.oracle import HAVE_DATA, agrees

pytestmark = pytest.mark.skipif(not HAVE_DATA, reason="the driver's tables aren't here")


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_query_agrees_with_duckdb(spark, name):
    assert agrees(spark, QUERIES[name], ORACLES[name])
