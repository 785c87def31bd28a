import pytest

from shareflow.llm.queries import ORACLES, QUERIES
from tests.oracle import HAVE_DATA, agrees


@pytest.mark.skipif(not HAVE_DATA, reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", ORACLES)
def test_query_agrees_with_duckdb(spark, name):
    assert agrees(spark, QUERIES[name], ORACLES[name])
