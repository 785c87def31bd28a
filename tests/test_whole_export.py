"""The full export has every row of its sections, however many there are, and the warnings."""

from collections import Counter

from pyspark.sql import functions as F

from shareflow.plans import reports, source_queries
from shareflow.sources import pages


def test_sections_are_whole(spark):
    snaps = spark.range(30 * 17).selectExpr("'00001' as code", "date_add(date '2024-01-01', cast(id div 30 as int)) as date", "format_string('B%05d', id % 30) as participant_id", "concat('P', id % 30) as participant_name", "id + 1 as shares", "id + 1 as bps")
    rows = spark.range(100).selectExpr("'00001' as code", "id as seq", "date_add(date '2024-01-01', cast(id as int)) as date")
    changes = rows.selectExpr("code", "seq", "date as change_date", "cast(seq as double) as shares_million", "'x' as reason")
    bought = rows.selectExpr("code", "seq", "date as buyback_date", "1.0D as amount_wan", "1.0D as shares_wan")
    prices = rows.selectExpr("code", "date", "'yahoo' as price_source", "1.0D as open", "1.0D as high", "1.0D as low", "1.0D as close", "seq as volume", "cast(null as double) as turnover", "cast(null as double) as vwap", "1.0D as turnover_est")
    log = rows.selectExpr("code", "seq", "'Holdings' as section", "date as fetched_on", "concat('error ', seq) as error_message", "'failed' as status", "0 as tables_found")
    meta = spark.createDataFrame([("00001", "One", 1000, None), ("00002", "Two", None, None)], "code string, name string, issued_shares long, issued_shares_as_of date")
    out = reports.full_export(snaps, changes, bought, log, prices, "test", meta).collect()
    got = Counter(r.section for r in out)
    assert got == {
        "Holdings": 30, "Changes": 30, "Big Changes": 480, "Concentration": 17, "Patterns": 1, "Moves": 30, "Price History": 100, "Share capital": 1, "Share changes": 100, "Buybacks": 100,
        "Fetch log": 100, "Metadata": 2, "status": 5, "warnings": 102,
    }
    facts = {r.code: (r["name"], r.issued_shares, r.history_depth_days, r.largest_participant) for r in out if r.section == "Metadata"}
    assert facts == {"00001": ("One", "1000", "17", "P29 (B00029)"), "00002": ("Two", None, None, None)}
    few = reports.full_export(snaps, changes, bought, log, prices, "test", meta, holdings_limit=3, changes_limit=4)
    assert (few.filter("section = 'Holdings'").count(), few.filter("section = 'Changes'").count()) == (3, 4)


def test_events_are_read_by_many_tasks(spark):
    rows = spark.range(3000).selectExpr("cast(id % 300 as string) as code", "id div 300 as k", "'2024-01-05' as day", "'Bonus' as type")
    made = source_queries.made_pages(rows, ["code"], ["Announced", "Type"], ["day", "type"], ["k"])
    found = pages.corporate_events(made, ["code", "page"], "https://s")
    assert found.count() == 3000 and found.select(F.spark_partition_id().alias("p")).distinct().count() > 8
