"""Changes with the dates given: the rows of the sweep by code, and no task that has a whole code."""

from collections import Counter
from datetime import date

from shareflow.operators import flows, snapshots
from tests.test_changes import SNAPS, some_snapshots


def test_dates_given(spark):
    rows = [*some_snapshots(), ("single", date(2024, 1, 1), "B00001", "x", 5, 1)]
    df = spark.createDataFrame(rows, SNAPS)
    of = lambda x: Counter(map(tuple, x.collect()))
    assert of(snapshots.consecutive_changes(df, snapshots.date_order(df))) == of(snapshots.consecutive_changes(df))


def test_a_code_is_spread_over_tasks(spark):
    # one code: the sum goes by participant too
    df = spark.range(4000).selectExpr("'a' as code", "date_add(date '2024-01-01', cast(id % 4 as int)) as date", "concat('B', id div 4) as participant_id", "'n' as participant_name", "id as shares", "id as bps")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in snapshots.consecutive_changes(df, snapshots.date_order(df)).selectExpr("spark_partition_id() as p").groupBy("p").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 3000 and max(sizes) < 1500


def test_adaptive_execution_leaves_the_tasks(spark):
    # however few the rows, the sum and the windows by date have more tasks than one a core
    df = spark.range(4000).selectExpr("concat('a', id % 10) as code", "date_add(date '2024-01-01', cast(id % 40 as int)) as date", "concat('B', id div 40) as participant_id", "'n' as participant_name", "id as shares", "id as bps")
    changes = snapshots.consecutive_changes(df, snapshots.date_order(df))
    for found in (changes, flows.change_patterns(changes)):
        assert found.selectExpr("spark_partition_id() as p").distinct().count() > 8
