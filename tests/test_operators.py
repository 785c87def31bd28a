"""Facts worked out by hand, and invariants over small data of our own."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from shareflow.functions import rules, scalars
from shareflow.operators import announcements, capital, concentration, flows, history, prices, quality, snapshots, tables
from shareflow.plans import reports

SNAP = "code string, date date, participant_id string, participant_name string, shares long, bps long"
D1, D2, D3 = date(2024, 1, 1), date(2024, 1, 2), date(2024, 1, 5)


@pytest.fixture
def snaps(spark):
    rows = [
        ("00001", D1, "B01660", "ALPHA SECURITIES", 100, 100_000), ("00001", D1, "C00010", "CITIBANK N.A.", 300, 300_000), ("00001", D1, "B01955", "FUTU X", 50, None),
        ("00001", D2, "C00010", "CITIBANK N.A.", 220, 220_000), ("00001", D2, "B01955", "FUTU X", 130, 130_000), ("00001", D2, "B00009", "KINGSWAY", 100, 100_000),
        ("00001", D3, "C00010", "CITIBANK N.A.", 220, 220_000), ("00002", D1, "C77777", "SOMEONE", 7, 0),
    ]
    return spark.createDataFrame(rows, SNAP)


def one(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_ranks_and_cumulative(snaps):
    got = one(snapshots.holdings_ranked(snaps).filter("code = '00001' and date = date '2024-01-01'").orderBy("rank"), "participant_id", "rank", "cumulative_bps")
    assert got == [("C00010", 1, 300_000), ("B01660", 2, 400_000), ("B01955", 3, 400_000)]


def test_concentration_keeps_the_place_of_a_missing_stake(spark):
    rows = [("1", D1, f"B0000{k}", "x", 100 - k, None if k == 0 else 10) for k in range(8)]
    df = spark.createDataFrame(rows, SNAP)
    r = snapshots.concentration_series(df).first()
    assert (r.top5_bps, r.top10_bps, r.total_bps) == (40, 70, 70) and abs(r.top5_pct_of_ccass - 400 / 7) < 1e-9
    assert snapshots.top_stakes(df).first().top_bps == 50
    zero = spark.createDataFrame([("1", D1, "B00001", "x", 1, 0)], SNAP)
    assert snapshots.concentration_series(zero).first().top5_pct_of_ccass is None


def test_dates(snaps):
    got = {r.code: (r.latest_date, r.previous_date, r.history_depth) for r in snapshots.date_summary(snaps).collect()}
    assert got == {"00001": (D3, D2, 3), "00002": (D1, None, 1)}
    assert one(quality.limited_history(snapshots.date_summary(snaps)), "code") == [("00002",)]


def test_changes(snaps):
    got = {(r.date, r.participant_id): (r.change_shares, r.change_bps, r.shares_after) for r in snapshots.consecutive_changes(snaps).collect()}
    assert got == {
        (D2, "B01660"): (-100, None, 0), (D2, "C00010"): (-80, -80_000, 220), (D2, "B01955"): (80, None, 130), (D2, "B00009"): (100, None, 100),
        (D3, "C00010"): (0, 0, 220), (D3, "B01955"): (-130, None, 0), (D3, "B00009"): (-100, None, 0),
    }


def test_diff_status_flow_and_invariants(snaps, spark):
    pairs = spark.createDataFrame([("00001", D1, D2)], "code string, date_a date, date_b date")
    changed, flow, summary = reports.diff_report(snaps, pairs)
    assert {r.participant_id: r.status for r in changed.collect()} == {"B01660": "exited", "C00010": "decreased", "B01955": "increased", "B00009": "new"}
    net = {r.category: r.net_change_shares for r in flow.collect()}
    assert net == {"unknown": -100, "intl_broker": -80, "retail": 80, "boutique": 100} and sum(net.values()) == 0
    s = summary.first()
    assert (s.participants_a, s.participants_b, s.n_new, s.n_exited, s.top5_bps_a, s.top5_bps_b) == (3, 3, 1, 1, 400_000, 450_000)
    back = snapshots.diff(snaps, pairs.select("code", F.col("date_b").alias("date_a"), F.col("date_a").alias("date_b")))
    forth = {r.participant_id: r.change_shares for r in snapshots.diff(snaps, pairs).collect()}
    assert {r.participant_id: -r.change_shares for r in back.collect()} == forth
    bad = spark.createDataFrame([(" ", "2024-01-01", "2024-01-02"), ("1", "x", "2024-01-02"), ("1", "2024-01-02", "2024-01-02"), ("1", "2024-01-01", "2024-01-02")], "code string, date_a string, date_b string")
    assert snapshots.invalid_pairs(bad).count() == 3


def test_categories(spark):
    rows = [("B01955", "HSBC"), ("b09999", "futu something"), ("C12345", "NOBODY"), ("B12345", "NOBODY"), ("B11111", None), ("B22222", "Merrill Lynch HSBC")]
    got = {r.participant_id: r.category for r in rules.with_category(spark.createDataFrame(rows, "participant_id string, participant_name string")).collect()}
    assert got == {"B01955": "retail", "b09999": "retail", "C12345": "bank", "B12345": "unknown", "B11111": "unknown", "B22222": "bank"}


def test_patterns_moves_and_transfers(spark):
    schema = "code string, date date, participant_id string, participant_name string, change_shares long, bps_after long"
    rows = [("1", D1, f"B0000{k}", n, c, b) for k, (n, c, b) in enumerate([("A Securities", 50, 20_000), ("B", 30, 0), ("C", 10, 0), ("Z Nominees", 5, None), ("D", -60, 0), ("E", -30, 0), ("F", 0, 0)])]
    changes = spark.createDataFrame(rows, schema)
    p = flows.change_patterns(changes).first()
    assert (p.gained, p.lost, p.large_increase, p.broker_increase, p.single_seller, p.spread_buying, p.transfer) == (95, 90, True, True, True, True, "yes")
    moves = flows.major_moves(changes, 2)
    assert one(moves.orderBy("direction", "move_rank"), "direction", "participant_name") == [("decrease", "D"), ("decrease", "E"), ("increase", "A Securities"), ("increase", "B")]
    texts = spark.createDataFrame([("A: B: +5",)], "text string")
    assert one(flows.split_move_text(texts), "name", "change") == [("A: B", "+5")]
    big = spark.createDataFrame([("1", D1, "P", 12.0), ("1", D1, "Q", -11.0), ("1", D1, "R", -14.5), ("1", D2, "S", -12.0), ("1", D1, "T", -9.9)], "code string, date date, participant_name string, change_pct double")
    assert one(flows.transfer_pairs(big), "gained_by", "lost_by") == [("P", "Q")]


def test_feed_rows(spark):
    feed = spark.createDataFrame([("1", 1, "24-01-05", "A"), ("1", 2, "", "B"), ("1", 3, None, "C"), ("1", 4, "24-01-04", " "), ("1", 5, "24-01-03", "D")], "code string, seq int, date string, participant_name string")
    assert one(flows.filled_dates(feed).orderBy("seq"), "date", "participant_name") == [("24-01-05", "A"), ("24-01-05", "B"), ("24-01-05", "C"), ("24-01-03", "D")]


def test_largest_participant_skips_totals_and_falls_back(spark):
    ranked = spark.createDataFrame([("1", D1, 1, "", "Total in CCASS", 9), ("1", D1, 2, "C00019", "Participant Name: BANK", 5)], "code string, date date, rank int, participant_id string, participant_name string, bps long")
    other = spark.createDataFrame([("1", D1, "B00001", "x", 9, 9), ("2", D1, "B00002", "y", 1, 1), ("2", D1, "B00003", "z", 5, 2)], SNAP)
    assert sorted(one(flows.largest_participant(ranked, other), "code", "participant_id", "participant_name")) == [("1", "C00019", "BANK"), ("2", "B00003", "z")]


def test_concentration_family(spark):
    days = [D1 + timedelta(k) for k in range(7)]
    feed = spark.createDataFrame([("1", d, 60.0 + k, 70.0 + k, None if k else 75.0, 74.23 if k < 6 else 741.23) for k, d in enumerate(days)] + [("2", D1, 1.0, 2.0, None, None)], "code string, date date, top5_pct double, top10_pct double, top10_ncip_pct double, stake_pct double")
    dual = {r.date: r for r in concentration.dual_basis(feed.filter("code = '1'")).collect()}
    assert abs(dual[days[0]].top5_pct_of_issued - 44.538) < 1e-9 and not dual[days[0]].issued_may_be_stale and dual[days[6]].issued_may_be_stale
    c = concentration.five_observation_change(feed).collect()
    assert len(c) == 1 and (c[0].from_date, c[0].to_date, c[0].top5_pct_change) == (days[2], days[6], 4.0)
    bands = {r.band: round(r.percent, 4) for r in concentration.bands(feed.filter(F.col("date") == D1).filter("code = '1'")).collect()}
    assert bands == {"Top 5": 60.0, "Top 6-10": 10.0, "NCIP": 5.0, "Outside CCASS": 25.77}
    assert concentration.out_of_range(feed).count() == 1 and {r.code: r.any_stale for r in concentration.stale_codes(feed).collect()} == {"1": True, "2": False}
    assert one(concentration.lines(feed), "metric", "percent") == [("top5_ncip", 65.0), ("top10_ncip", 75.0)]


def test_price_family(spark):
    schema = "code string, date date, price_source string, open double, high double, low double, close double, volume long, turnover double, vwap double, turnover_est double"
    row = lambda d, c, v, t: ("1", d, "yahoo", c, c, c, c, v, t, None, c * v)
    bars = spark.createDataFrame([row(D1, 10.0, 100, 5.0), row(D2, 11.0, 200, None), row(D2 + timedelta(20), 5.5, 0, 15.0)], schema)
    chart = prices.chart_frame(bars, None).orderBy("date").collect()
    assert [(r.gap_days, r.segment) for r in chart] == [(1, 0), (1, 0), (20, 1)] and [r.daily_change_pct for r in chart][0] is None and round(chart[1].daily_change_pct, 6) == 10.0
    assert one(prices.suspensions(prices.chart_frame(bars, None)), "start_date", "end_date") == [(D2, D2 + timedelta(20))]
    assert prices.chart_frame(bars, 10).count() == 1
    stats = prices.price_stats(bars, spark.createDataFrame([("1", 1000)], "code string, issued_shares long")).first()
    assert (stats.close, stats.previous_close, stats.daily_change_pct, stats.mean_turnover, stats.turnover_vs_mean_pct, stats.turnover_rate_pct) == (5.5, 11.0, -50.0, 10.0, 150.0, 0.0)
    latest = one(prices.latest_prices(bars, 2).orderBy("row_number"), "date", "vwap_est")
    assert latest == [(D2 + timedelta(20), None), (D2, 11.0)]
    cap = spark.createDataFrame([("1", 500, D1)], "code string, shares long, as_of date")
    meta = spark.createDataFrame([("1", 900, D1), ("2", 5, D1)], "code string, issued_shares long, issued_shares_as_of date")
    r = prices.with_share_capital(bars.filter(F.col("date") == D1), cap, meta).first()
    assert (r.issued_shares, r.issued_source, r.market_cap, r.turnover_to_cap_pct) == (500, "share_changes", 5000.0, 0.1)
    made = prices.price_table(spark.createDataFrame([("1", D1, 1.2345, 1.2345, 1.0, 1.1, 1000), ("1", D2, 1.0, 1.0, 1.0, 1.0, None)], "code string, date date, open double, high double, low double, close double, volume long")).orderBy("date").collect()
    assert (made[0].high, made[0].turnover_est, made[0].vwap_est, made[1].volume, made[1].vwap_est) == (1.235, 1100.0, 1.1, 0, None)
    lines = spark.createDataFrame([("1", "support, 5.5\nbad\nx,y,7")], "code string, text string")
    assert one(prices.parse_cost_lines(lines), "label", "price") == [("support", 5.5)]  # the second field of x,y,7 is no amount
    assert one(prices.parse_event_markers(spark.createDataFrame([("1", "2024-01-02,placing\nno")], "code string, text string")), "date", "label") == [(D2, "placing")]
    assert one(prices.overlay(bars, spark.createDataFrame([("1", "s", 5.0)], "code string, label string, price double")).orderBy("date"), "date") == [(D1,), (D2 + timedelta(20),)]


def test_histories(spark, snaps):
    dates = spark.createDataFrame([("1", D1 + timedelta(30 * k)) for k in range(14)], "code string, date date")
    got = [(r.date - D1).days // 30 for r in history.sampled_dates(dates, 4).orderBy("date").collect()]
    assert got == [1 + round(i * 12 / 3) for i in range(4)]
    frame = reports.participant_history(snaps, 2, 3).filter("code = '00001'").collect()
    assert len(frame) == 3 and {r.participant_id for r in frame} == {"C00010"}


def test_capital_and_announcements(spark):
    rows = [("1", 1, D2, 858.33, "配售新股,供股,行使购股权"), ("1", 2, D3, None, "x"), ("1", 3, D1, 1.0, None), ("1", 4, None, 2.0, None)]
    changes = spark.createDataFrame(rows, "code string, seq int, change_date date, shares_million double, reason string")
    r = capital.latest_capital(changes).first()
    assert (r.shares, r.as_of) == (858_330_000, D2)
    assert capital.tagged_changes(changes).filter("seq = 1").first().reason_tags == ["placement", "option_exercise", "rights_issue"]
    news = spark.createDataFrame([(1, "1", "公告", "建議供股及停牌", D1), (2, "1", "x", "Cargo Move", D2), (3, "1", "x", "LET GO Offer", D3)], "news_id long, code string, category string, title string, publish_date date")
    assert one(announcements.timeline(news), "news_id", "event_tags") == [(1, ["rights_issue", "trading_halt"]), (3, ["general_offer"])]
    assert announcements.in_period(news, "2025-01-02", 0).count() == 1
    assert announcements.tag_summary(news).first().tags == "general_offer,rights_issue,trading_halt"


def test_quality(spark):
    log = spark.createDataFrame(
        [(1, "1", "Holdings", D1, "", "success", 1), (2, "1", "Big Changes", D1, "Local history has 1 day", "failed", 0), (3, "1", "Changes", D1, "Read timed out", "failed", 0), (4, "1", "Changes", D2, "Read timed out", "False", 0), (5, "2", "Holdings", D1, "", "failed", 0)],
        "seq int, code string, section string, fetched_on date, error_message string, status string, tables_found int",
    )
    errors = quality.structured_errors(log)
    assert sorted(one(errors, "seq", "error_code", "retry")) == [(3, "SOURCE_TIMEOUT", True), (4, "SOURCE_TIMEOUT", True), (5, "PARSE_ERROR", False)]
    assert quality.distinct_errors(errors).count() == 2
    assert one(quality.primary_failure(log).orderBy("code"), "code", "seq") == [("1", 2), ("2", 5)]
    assert quality.failure_warnings(log).filter("warning like 'Big Changes unavailable%'").count() == 1
    assert one(quality.run_totals(log).orderBy("fetched_on"), "total", "ok", "failed") == [(4, 1, 3), (1, 0, 1)]
    summary = {(r.code, r.section): r.status for r in quality.fetch_summary(log).collect()}
    assert summary["1", "Changes"] == "False" and summary["2", "Concentration"] == "missing" and len(summary) == 10
    warnings = spark.createDataFrame([("1", 1, "Issue lookup failed for 5"), ("1", 2, "value may be stale"), ("1", 3, "cold start")], "code string, seq int, warning string")
    assert sorted(one(quality.errors_from_warnings(warnings), "error_code")) == [("COLD_START",), ("ISSUE_LOOKUP_FAILED",)]
    present = spark.createDataFrame([("1", False, True, True, True), ("2", True, False, True, True)], "code string, holdings boolean, changes boolean, big_changes boolean, concentration boolean")
    assert quality.cross_section_warnings(present).count() == 2
    filled = quality.with_provenance(spark.createDataFrame([(" ",), ("mine",)], "source string"), F.lit(D1), "registry").collect()
    assert [r.source for r in filled] == ["registry", "mine"] and filled[0].data_as_of == D1
    codes = {"connection reset": "SOURCE_FETCH_FAILED", "human verification": "SOURCE_CHALLENGE", "parsing failed": "PARSE_ERROR", "budget exhausted": "COLD_START", "weird": "PARSE_ERROR"}
    df = spark.createDataFrame([(k,) for k in codes], "m string").select("m", rules.error_code(F.lit(None).cast("string"), F.col("m")).alias("c"))
    assert {r.m: r.c for r in df.collect()} == codes


def value(spark, expression):
    return spark.range(1).select(expression.alias("v")).first().v


def text(spark, function, *values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, t string")
    return [r.v for r in rows.select("k", function(F.col("t")).alias("v")).orderBy("k").collect()]


def test_scalars(spark):
    assert text(spark, scalars.stock_code, "5", "HK 700", "1234567", "x") == ["00005", "00700", "1234567", ""]
    assert text(spark, scalars.participant_id, "PARTICIPANT ID: c00019", "D12345", None) == ["C00019", "", ""]
    assert text(spark, scalars.participant_name, "Name of CCASS Participant (* for Consenting Investor Participants): A", " participant name : B ", None) == ["A", "B", ""]
    assert text(spark, scalars.to_number, "1,260,000", "+0.9%", "x", None) == [1_260_000.0, 0.9, None, None]
    assert text(spark, scalars.whole_number, "1,000 x", "none") == [1000, 0]
    assert text(spark, scalars.numeric_amount, "HK$1.2M", "$5k", "3B", "x", "") == [1_200_000.0, 5000.0, 3e9, None, None]
    assert text(spark, scalars.numeric_percent, "1,2.5%", "5 of 9", None) == [12.5, None, None]
    assert text(spark, scalars.percent_text, "5", "5%", "", None) == ["5%", "5%", "", ""]
    assert [str(x) for x in text(spark, scalars.parse_date, "24-02-03", "2024/2/3", "3 Feb 2024", "2024-13-01", "junk", None)] == ["2024-02-03"] * 3 + ["None"] * 3
    assert text(spark, scalars.dash_to_null, " -- ", "-", " a  b ", None) == [None, None, "a b", None]
    assert text(spark, scalars.ticker, "01449", "00005", "12345") == ["1449.HK", "0005.HK", "12345.HK"] and text(spark, scalars.slug, "00550") == ["HK0550"]
    assert text(spark, lambda c: scalars.absolute_link(c, "https://s", "f/"), "http://x", "/a", "b") == ["http://x", "https://s/a", "https://s/f/b"]
    assert text(spark, scalars.groups, "A; b|a;;", None) == [["a", "b"], []]
    assert text(spark, scalars.looks_like_issue_id, "1234", "0123", "123", None) == [True, False, False, False]
    label = text(spark, lambda c: scalars.participant_label(c, F.lit("B1")), "THE  (HONG KONG) COMPANY LIMITED", "X" * 40)
    assert label == ["THE (HK) CO LTD (B1)", "X" * 31 + "... (B1)"]
    assert [value(spark, scalars.period_bucket(F.lit(n))) for n in (5, 6, 40, 100, 300, 700, 9999)] == ["5d", "1mo", "3mo", "6mo", "1y", "2y", "5y"]
    assert [value(spark, scalars.hk_amount(F.lit(v))) for v in (2.5e9, 1.234e6, 1500.0, 12.0, None)] == ["HK$2.50B", "HK$1.23M", "HK$1.5K", "HK$12", "-"]
    assert [value(spark, scalars.share_amount(F.lit(v))) for v in (2400, 12)] == ["2K shares", "12 shares"]
    assert [value(spark, scalars.price_text(F.lit(v))) for v in (1.25, 3.0, None)] == ["HK$1.25", "HK$3", "-"]
    assert [value(spark, scalars.signed_percent(F.lit(v))) for v in (1.5, -2.0, None)] == ["+1.50%", "-2.00%", "-"]
    assert value(spark, scalars.json_safe(F.lit(float("nan")))) is None and value(spark, scalars.json_safe(F.lit(1.5))) == 1.5
    assert value(spark, scalars.ratio_percent(F.lit(1.0), F.lit(0.0))) is None and value(spark, scalars.market_cap(F.lit(2.0), F.lit(10))) == 20.0
    hosts = ["www1.example.com"]
    urls = text(spark, lambda c: scalars.allowed_url(c, hosts), "https://www1.example.com/a/b.pdf#x", "http://www1.example.com/a", "https://u:p@www1.example.com/a", "https://www1.example.com:444/a", "https://other.com/a", None)
    assert urls == ["https://www1.example.com/a/b.pdf", None, None, None, None, None]
    d = text(spark, lambda c: scalars.date_from_path(c, F.lit(D1)), "https://x/2023/0105/a.pdf", "https://x/a.pdf")
    assert [(r.date, r.note is None) for r in d] == [(date(2023, 1, 5), True), (D1, False)]
    assert text(spark, scalars.clean_extracted, "a \x00b�  \nc") == ["a b\nc"]
    t = text(spark, lambda c: scalars.truncated(c, 3), "abcdef", "ab")
    assert [(r.head, r.chars_total, r.chars_returned, r.truncated) for r in t] == [("abc", 6, 3, True), ("ab", 2, 2, False)]
    q = text(spark, scalars.text_quality, "股份ab1 �")
    assert (q[0].score, q[0].visible) == (3, 6)


def test_generic_tables(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 3, "x"), ("b", 1, "z")], "k string, seq int, v string")
    assert one(tables.first_rows(df, ["k", "v"], [F.asc("seq")]).orderBy("k", "seq"), "seq") == [(1,), (2,), (1,)]
    counts = {r.k: (r.total_rows, r.returned_rows, r.truncated) for r in tables.section_counts(df, ["k"], 2).collect()}
    assert counts == {"a": (3, 2, True), "b": (1, 1, False)}
    codes = spark.createDataFrame([(1, "5"), (2, "00005"), (3, "x"), (4, "7"), (5, "8")], "seq int, code string")
    assert one(reports.requested_codes(codes, 2).orderBy(F.asc_nulls_last("number")), "code", "over") == [("00005", False), ("00007", False), ("00008", True)]
