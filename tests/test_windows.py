"""The registered price windows have the whole range that they are named for; shorter ranges are tested on rows of their own."""

from datetime import date, timedelta

from shareflow.operators import prices
from shareflow.operators.tables import RANGES
from shareflow.plans import reports, source_queries  # noqa: F401 (registers queries)
from shareflow.plans.queries import ORACLES, QUERIES
from tests.oracle import SF_DIR


def _bars(spark, days):
    rows = [("00001", date(2024, 1, 31) - timedelta(k), "yahoo", 1.0, 1.0, 1.0, 1.0, 1, None, None, 1.0) for k in range(days)]
    return spark.createDataFrame(rows, "code string, date date, price_source string, open double, high double, low double, close double, volume long, turnover double, vwap double, turnover_est double")


def test_price_window_is_a_month(spark):
    assert f"interval {RANGES['1M']} day" in ORACLES["price_window"]
    history = spark.read.parquet(f"{SF_DIR}/events.parquet").selectExpr("user_id", "cast(ts as date) as date", "user_id % 3 = 0 as mirror").distinct()
    # the events span less than a month, so none of their days may be missing
    assert history.selectExpr("date_diff(max(date), min(date)) as d").first().d <= 31
    assert QUERIES["price_window"](spark, SF_DIR).count() == history.count()


def test_chart_of_fewer_days(spark):
    assert prices.chart_frame(_bars(spark, 30), 12).count() == 13


def test_price_report_window_is_thirty_days(spark):
    assert "interval 30 day" in ORACLES["price_report_window"] and "2024-01-12" not in ORACLES["price_report_window"]
    history = spark.read.parquet(f"{SF_DIR}/events.parquet").selectExpr("user_id", "cast(ts as date) as date", "user_id % 3 = 0 as mirror").distinct()
    # the report shows at most 20 rows of a code: none of those is missing
    whole = history.groupBy("user_id").count().selectExpr("sum(least(count, 20)) as n").first().n
    assert QUERIES["price_report_window"](spark, SF_DIR).count() == whole


def test_price_report_of_fewer_days_and_a_start(spark):
    changes = spark.createDataFrame([("00001", 1, date(2024, 1, 1), 5.0, "x")], "code string, seq long, change_date date, shares_million double, reason string")
    meta = spark.createDataFrame([("00001", "A", 10, date(2024, 1, 31))], "code string, name string, issued_shares long, issued_shares_as_of date")
    of = lambda **cut: reports.price_report(_bars(spark, 25), changes, meta, **cut).prices.count()
    assert (of(days=15), of(days=15, start="2024-01-20"), of(start="2024-01-20")) == (16, 12, 12)
