"""Holdings are summed after their rows are dealt: no task sums a whole split of the file."""

import pytest

from shareflow.sources.views import view
from tests.oracle import HAVE_DATA, SF_DIR


@pytest.mark.skipif(not HAVE_DATA, reason="needs the driver's tables")
def test_no_sum_before_the_rows_are_dealt(spark):
    held = view(spark, SF_DIR, "held")
    # ten suppliers in the smallest tables
    assert held.selectExpr("spark_partition_id() as p").distinct().count() > 4
    text = held._jdf.queryExecution().sparkPlan().toString()
    assert text.index("HashAggregate") < text.index("Exchange") and "HashAggregate" not in text[text.index("Exchange") :]
