from datetime import date


from shareflow.functions import columns
from shareflow.sources import feeds, pages

REGISTRY = """<html><body><div>Shareholding Date: 2024/03/04</div><p>00123 SAMPLE HOLDINGS</p><div>Issued Shares : 2,000</div>
<table><tr><th>Menu</th></tr><tr><td>Home</td></tr></table>
<table><tr><th>Participant ID</th><th>Participant Name</th><th>Shareholding</th><th>% of the total Issued Shares</th></tr>
<tr><td>C00019</td><td>FIRST&nbsp;BANK</td><td>1,000</td><td>50.00%</td></tr>
<tr><td>B01955</td><td>A BROKER</td><td>400</td><td>20%</td></tr><tr><td>Total</td><td>All</td><td>1,400</td><td>70%</td></tr></table>"""
OFFICERS = """<h2>Sample Ltd</h2><a href="orgdata.asp?p=77">x</a><div class="letterbox">Closing soon</div><h3>Directors</h3>
<table class="opltable"><tr><th></th><th>Name</th><th>&#9893;</th><th>Age</th><th>Position</th><th>From</th><th>Until</th></tr>
<tr><td>1</td><td><a href="positions.asp?p=12">Chan, A</a></td><td>M</td><td>51</td><td><span class="info">ED<span>Executive Director</span></span></td><td>2020-01-01</td><td></td></tr>
<tr><td></td><td></td><td></td><td></td><td>NED</td><td>2019-01-01</td><td>2020-01-01</td></tr>
<tr><td>2</td><td><a href="/p/positions.asp?p=13">Lee, B</a></td><td>F</td><td></td><td>INED</td><td>2018-05-01</td><td>2021-05-01</td></tr></table>"""
EVENTS = """<table><tr><td>nav</td></tr></table><table><tr><th>Announced</th><th>Year-end</th><th>Type</th><th>New:Old</th><th>ex-Date</th></tr>
<tr><td>2024-01-05</td><td></td><td><a href="eventdets.asp?e=9">Consolidation</a></td><td>1:10</td><td>2024-02-01</td></tr><tr><td></td><td></td><td></td><td></td><td></td></tr></table>"""
MANAGERS = """<table class="ggintro"><tr><td class="title">张三</td><td class="jobs">主席</td></tr><tr><td class="date">本届任期：2020-01-20 至今</td><td class="intro">男 52 本科</td></tr>
<tr><td class="salary">报酬：--</td></tr><tr><td class="mainintro">text</td></tr></table><table class="ggintro"><tr><td class="title">李四</td></tr><tr><td class="date">本届任期：2019-01-01 2020-02-02</td><td class="intro">女  硕士</td></tr></table>"""
EQUITY = """<div id="change"><h2>股本变化</h2><table><tr><td>公告</td><td>股本</td><td>原因</td><td>日期</td></tr>
<tr><td>2024-01-03</td><td>1,858.33</td><td>配售新股及供股</td><td>2024-01-02</td></tr><tr><td>2023-01-03</td><td>--</td><td>--</td><td>2023-01-02</td></tr></table></div>
<div class="m_box"><h2>股份回购</h2><table><tr><td>--</td><td>2024-01-02</td><td>1.5</td><td>2</td><td>3.1</td><td>3.0</td><td>场内</td><td>HKD</td></tr><tr><td>short</td></tr></table></div>"""


def frame(spark, html):
    return spark.createDataFrame([(1, html), (2, None), (3, "<p>no table"), (4, "<table><tr><td>broken")], "page_id long, html string")


def test_registry_snapshot(spark):
    df = spark.createDataFrame([("00123", date(2024, 3, 4), REGISTRY)], "code string, query_date date, html string")
    got = {r.participant_id: (r.participant_name, r.shares, r.pct_of_issued) for r in pages.registry_snapshots(df).collect()}
    assert got == {"C00019": ("FIRST BANK", 1000, 50.0), "B01955": ("A BROKER", 400, 20.0)}
    meta = pages.page_metadata(df, ["code"]).first()
    assert meta.issued_shares == 2000 and meta.holdings_date == date(2024, 3, 4)


def test_holdings_page_takes_the_table_with_most_ids(spark):
    small = "<table><tr><th>CCASS ID</th><th>Name</th><th>Holding</th><th>Stake %</th></tr><tr><td>B00001</td><td>A</td><td>1</td><td>1</td></tr></table>"
    large = "<table><tr><th>CCASS ID</th><th>Name</th><th>Holding</th><th>Stake %</th></tr><tr><td>C00010</td><td>B</td><td>2,000</td><td>5.5</td></tr><tr><td>B00002</td><td>C</td><td>3</td><td></td></tr><tr><td></td><td>Total in CCASS</td><td>9</td><td>9</td></tr></table>"
    df = spark.createDataFrame([("1", "2024-01-01", small + large)], "code string, date string, html string")
    assert {(r.participant_id, r.shares, r.stake_pct) for r in pages.holdings_pages(df).collect()} == {("C00010", 2000, 5.5), ("B00002", 3, None)}


def test_officers(spark):
    got = pages.officers(frame(spark, OFFICERS), ["page_id"], "https://site").orderBy("row_no").collect()
    assert [(r.name, r.person_id, r.sex, r.age, r.position_code, r.position, r.is_current, r.table_group) for r in got] == [
        ("Chan, A", "12", "M", 51, "ED", "Executive Director", True, "Directors"),
        ("Lee, B", "13", "F", None, "INED", None, False, "Directors"),
    ]
    assert got[1].person_url == "https://site/p/positions.asp?p=13"
    meta = pages.page_metadata(frame(spark, OFFICERS), ["page_id"]).filter("page_id = 1").first()
    assert (meta.org_id, meta.page_name, meta.shutdown_notice) == ("77", "Sample Ltd", "Closing soon")


def test_corporate_events(spark):
    got = pages.corporate_events(frame(spark, EVENTS), ["page_id"], "https://site").collect()
    assert [(r.announced, r.type, r.new_old, r.ex_date, r.event_id, r.event_details_url) for r in got] == [("2024-01-05", "Consolidation", "1:10", "2024-02-01", "9", "https://site/dbpub/eventdets.asp?e=9")]


def test_managers(spark):
    got = pages.managers(frame(spark, MANAGERS), ["page_id"]).orderBy("table_no").collect()
    assert (got[0].name, got[0].positions, str(got[0].tenure_from), got[0].tenure_to, got[0].is_current, got[0].sex, got[0].age, got[0].education, got[0].salary) == ("张三", "主席", "2020-01-20", None, True, "男", 52, "本科", None)
    assert (str(got[1].tenure_to), got[1].is_current, got[1].age, got[1].education) == ("2020-02-02", False, None, "硕士")


def test_equity(spark):
    rows = pages.share_changes(frame(spark, EQUITY), ["page_id"]).orderBy("seq").collect()
    assert [(r.announce_date, r.shares_approx, r.reason_tags) for r in rows] == [("2024-01-03", 1858330000, ["placement", "rights_issue"]), ("2023-01-03", None, [])]
    got = pages.buybacks(frame(spark, EQUITY), ["page_id"]).collect()
    assert [(r.announce_date, r.buyback_date, r.amount_wan, r.currency) for r in got] == [(None, "2024-01-02", 1.5, "HKD")]


def test_sections_previews_facts(spark):
    html = REGISTRY + "<table><tr><th>Date</th><th>Top 5 %</th><th>Top 10 %</th><th>Stake in CCASS %</th></tr><tr><td>2024-01-01</td><td>1</td><td>2</td><td>3</td></tr></table><table><tr><td>Trading date</td><td>2024-01-01</td></tr><tr><td>Volume</td><td>5</td></tr></table>"
    tables = pages.html_tables(frame(spark, html), ["page_id"])
    got = {r.section: r.table_no for r in pages.section_tables(tables, ["page_id"]).filter("page_id = 1").collect()}
    assert got["Concentration"] == 2 and "Price History" not in got
    assert {r.section: r.table_no for r in pages.section_tables(tables, ["page_id"], {"Holdings": 1}).filter("page_id = 1").collect()}["Holdings"] == 1
    preview = pages.table_previews(tables, ["page_id"]).filter("page_id = 1 and table_no = 1").first()
    assert (preview.n_rows, preview.n_columns, len(preview.sample)) == (3, 4, 3)
    facts = pages.key_values(tables, ["page_id"], {"day": ["trading date"], "volume": ["volume"]}).filter("page_id = 1").first()
    assert (facts.day, facts.volume) == ("2024-01-01", "5")


def test_page_text_and_links(spark):
    text = pages.page_texts(frame(spark, "<title>T</title><script>x</script><h1>Head</h1><p>one</p><p>two</p>"), ["page_id"]).filter("page_id = 1").first()
    assert (text.title, text.h1, text.text) == ("T", "Head", "Head one two")
    assert pages.outbound_links(frame(spark, '<a href="/a">x</a><a class=b href="/c">y</a>'), ["page_id"]).count() == 2


def test_harmonised_columns(spark):
    df = spark.createDataFrame([("1", "2")], "`Name of CCASS participant` string, `Holding %` string")
    assert columns.harmonised(df, {"participant": ["participant"], "stake": ["stake", "%"], "none": ["zzz"]}).first().asDict() == {"participant": "1", "stake": "2", "none": None}


def test_feeds(spark, tmp_path):
    (tmp_path / "w.csv").write_text("code,name,group\n5,A,Core;x\n00005,B,y\nHK 700,C,core|z\n")
    got = {r.code: (r.name, r.groups) for r in feeds.read_watchlist(spark, str(tmp_path / "w.csv")).collect()}
    assert got == {"00005": ("A", ["core", "x"]), "00700": ("C", ["core", "z"])}
    assert {r.code for r in feeds.read_watchlist(spark, str(tmp_path / "w.csv"), "X").collect()} == {"00005"}
    (tmp_path / "h.csv").write_text("5,A,Core\n6,B,\n")
    assert feeds.read_watchlist(spark, str(tmp_path / "h.csv"), header=False).count() == 2
    (tmp_path / "w.json").write_text('{"codes": ["5", "700", "5"]}')
    assert sorted(r.code for r in feeds.read_watchlist_json(spark, str(tmp_path / "w.json")).collect()) == ["00005", "00700"]
    (tmp_path / "c.json").write_text('{"by_ccass_id": {" b00001 ": "retail"}, "by_name_keyword": {"Zeta": "bank", "Alpha": "retail"}}')
    ids, words = feeds.read_category_rules(spark, str(tmp_path / "c.json"))
    assert [tuple(r) for r in ids.collect()] == [("B00001", "retail")] and [r.keyword for r in words.orderBy("priority").collect()] == ["ZETA", "ALPHA"]


def test_chart_feed(spark):
    good = '{"chart":{"result":[{"timestamp":[1704153600,null,1704240000],"indicators":{"quote":[{"open":[1.0,2.0,3.0],"high":[1.0,2.0,3.0],"low":[1.0,2.0,3.0],"close":[1.5,2.0,null],"volume":[10,20,30]}]}}],"error":null}}'
    bad = '{"chart":{"result":null,"error":{"code":"Not Found","description":"No data"}}}'
    bars, errors = feeds.daily_bars(spark.createDataFrame([("1", good), ("2", bad), ("3", None)], "code string, json string"))
    assert [(r.code, str(r.date), r.close, r.volume) for r in bars.orderBy("date").collect()] == [("1", "2024-01-02", 1.5, 10), ("1", "2024-01-03", None, 30)]
    assert {r.code: r.error for r in errors.collect()} == {"2": "No data", "3": "no data"}


def test_announcement_feed(spark):
    item = '{"NEWS_ID":"9","DATE_TIME":"05/01/2024 08:30","STOCK_CODE":"700","STOCK_NAME":"T","LONG_TEXT":"","SHORT_TEXT":"<b>Short</b>","TITLE":"A<br>B","FILE_LINK":"/x.pdf"}'
    text = '{"result":"' + f"[{item}]".replace('"', '\\"') + '"}'
    df = spark.createDataFrame([(f'{{"result":[{item}]}}',), (text,), ('{"result":"null"}',), ("{}",)], "json string")
    got = feeds.announcements(df, "https://s").collect()
    assert len(got) == 2 and {(r.code, r.category, r.title, r.url, str(r.publish_time)) for r in got} == {("00700", "Short", "A B", "https://s/x.pdf", "2024-01-05 08:30:00")}


def test_payloads_of_any_form(spark):
    item = '{"NEWS_ID":7,"TITLE":"A"}'
    forms = {
        "list": f'{{"result":[{item}]}}', "text": '{"result":"[{\\"NEWS_ID\\":\\"7\\"}]"}', "null": '{"result":null}', "null text": '{"result":"null"}', "absent": "{}", "empty": '{"result":[]}', "blank": "", "nothing": None,
        "error": '{"error":{"message":"busy"}}', "error text": '{"error":"closed","result":null}', "malformed": "<html>", "broken": '{"result":"[{"}', "object": '{"result":{"a":1}}', "number": '{"result":3}',
    }
    df = spark.createDataFrame(list(forms.items()), "form string, json string")
    assert [(r.news_id, r.title) for r in feeds.announcements(df, "https://s").orderBy("title").collect()] == [("7", ""), ("7", "A")]
    errors = {r.form: r.error for r in feeds.announcement_errors(df).collect()}
    assert errors == {"error": "busy", "error text": "closed", "malformed": "malformed payload", "broken": "malformed result", "object": "result is no list", "number": "result is no list"}


def test_chart_payloads_of_any_form(spark):
    chart = lambda quote: f'{{"chart":{{"result":[{{"timestamp":[1704153600,1704240000],"indicators":{{"quote":[{quote}]}}}}]}}}}'
    forms = {"short": chart('{"close":[1.5],"volume":[3,4]}'), "bad value": chart('{"close":["x",2],"volume":[null,1.0]}'), "no quote": chart("{}"), "error": '{"chart":{"error":{"code":"E"}}}', "list": "[1]", "malformed": "{", "none": '{"chart":{"result":[]}}', "null": '{"chart":null}'}
    bars, errors = feeds.daily_bars(spark.createDataFrame(list(forms.items()), "code string, json string"))
    got = {}
    for r in bars.orderBy("date").collect():
        got.setdefault(r.code, []).append((r.close, r.volume))
    assert got == {"short": [(1.5, 3), (None, 4)], "bad value": [(None, None), (2.0, 1)], "no quote": [(None, None), (None, None)]}
    assert {r.code: r.error for r in errors.collect()} == {"error": "E", "list": "no data", "malformed": "malformed payload", "none": "no data", "null": "no data"}


def test_issue_and_stock_lookups(spark):
    issues = spark.createDataFrame([("00001", "1234")], "code string, issue_id string")
    assert feeds.with_issue_id(spark.createDataFrame([("00001",), ("00002",)], "code string"), issues).filter("issue_id is null").count() == 1
    assert feeds.codes_of_issues(spark.createDataFrame([("1234",)], "issue_id string"), issues).first().code == "00001"
    stocks = spark.createDataFrame([("1", "L1", "One")], "code string, listing_id string, name string")
    assert feeds.active_stocks(spark.createDataFrame([("HK00001",)], "code string"), stocks).first().name == "One"


def test_section_rows(spark):
    html = (
        "<table><tr><th>Name of CCASS participant</th><th>CCASS ID</th><th>Holding</th><th>Stake %</th><th>Cumul stake %</th></tr><tr><td>A</td><td>B00001</td><td>1,000</td><td>5.5%</td><td>5.5%</td></tr><tr><td> </td><td></td><td>9</td><td></td><td></td></tr></table>"
        "<table><tr><th>Date</th><th>Participant</th><th>Change %</th></tr><tr><td>24-01-05</td><td>A</td><td>+12.5</td></tr><tr><td></td><td>B</td><td>-12</td></tr></table>"
        "<table><tr><th>Date</th><th>Top 5 %</th><th>Top 10 + NCIP %</th><th>Top 10 %</th><th>Stake in CCASS %</th></tr><tr><td>2024-01-01</td><td>1</td><td>3</td><td>2</td><td>9</td></tr></table>"
        "<table><tr><th>Date</th><th>Close</th><th>Volume</th><th>Turnover</th><th>VWAP</th></tr><tr><td>2024-01-01</td><td>1.5</td><td>1,000</td><td>2</td><td>x</td></tr></table>"
    )
    tables = pages.html_tables(frame(spark, html), ["page_id"])
    get = lambda section: [r.asDict() for r in pages.section_rows(tables, ["page_id"], section).orderBy("row_no").collect()]
    holdings = get("Holdings")
    assert len(holdings) == 1 and (holdings[0]["rank"], holdings[0]["shares"], holdings[0]["cumulative"]) == (1, 1000.0, 5.5)
    assert [(str(r["date"]), r["participant_name"], r["change_pct"], r["change_shares"]) for r in get("Big Changes")] == [("2024-01-05", "A", 12.5, None), ("2024-01-05", "B", -12.0, None)]
    assert [(r["top5"], r["top10"], r["top10_ncip"], r["stake"]) for r in get("Concentration")] == [(1.0, 2.0, 3.0, 9.0)]
    assert [(r["close"], r["volume"], r["vwap"], r["open"]) for r in get("Price History")] == [(1.5, 1000.0, None, None)]


def test_page_reports(spark):
    from shareflow.plans import reports

    page = spark.createDataFrame([("00001", EVENTS)], "code string, html string")
    r = reports.events_report(page, "https://s").collect()
    assert len(r) == 1 and r[0].data_as_of == "2024-01-05"
    people, bosses = reports.people_report(spark.createDataFrame([("00001", OFFICERS)], "code string, html string"), spark.createDataFrame([("00001", MANAGERS)], "code string, html string"), "https://s")
    assert people.count() == 1 and bosses.count() == 2


def test_malformed_page_costs_only_itself(spark):
    df = spark.createDataFrame([(1, "<table><tr><td>a</td></tr></table><![x[ <table><tr><td>lost</td></tr></table>"), (2, "<table><tr><td>b</td></tr></table>"), (3, None)], "k long, html string")
    got = {(r.k, r.cells[0].text) for r in pages.html_tables(df, ["k"]).collect()}
    assert {(1, "a"), (2, "b")} <= got
    assert pages.page_metadata(df, ["k"]).count() == 3


def cells_of(spark, html):
    rows = pages.html_tables(spark.createDataFrame([(1, html)], "page_id long, html string"), ["page_id"]).orderBy("table_no", "row_no").collect()
    return [(r.row_no, r.is_header, r.header, [c.text for c in r.cells]) for r in rows]


def test_spans_fill_the_grid(spark):
    html = """<table><tr><th>ID</th><th>Name</th><th>Shares</th></tr><tr><td rowspan="2">B1</td><td>A</td><td>5</td></tr><tr><td>B</td><td>7</td></tr>
<tr><td colspan=2>both</td><td>1</td></tr><tr><td rowspan=0>to the end</td><td>x</td><td>2</td></tr><tr><td>y</td><td>3</td></tr></table>"""
    assert [c for _, _, _, c in cells_of(spark, html)] == [["ID", "Name", "Shares"], ["B1", "A", "5"], ["B1", "B", "7"], ["both", "both", "1"], ["to the end", "x", "2"], ["to the end", "y", "3"]]
    nested = "<table><tr><td rowspan=2 colspan=2>a</td><td rowspan=3>b</td></tr><tr><td>c</td></tr><tr><td>d</td><td>e</td><td>f</td></tr></table>"
    assert [c for _, _, _, c in cells_of(spark, nested)] == [["a", "a", "b"], ["a", "a", "b", "c"], ["d", "e", "b", "f"]]
    odd = "<table><tr><td colspan='x' rowspan='-1'>a</td><td colspan=''>b</td></tr></table>"
    assert [c for _, _, _, c in cells_of(spark, odd)] == [["a", "b"]]


def test_header_bands(spark):
    two = '<table><tr><th colspan="2">Holder</th><th rowspan="2">Balance</th></tr><tr><th>Nation</th><th>Name</th></tr><tr><td>N</td><td>S</td><td>1</td></tr></table>'
    head = ["Holder Nation", "Holder Name", "Balance"]
    assert cells_of(spark, two) == [(-1, True, head, ["Holder", "Holder", "Balance"]), (0, True, head, ["Nation", "Name", "Balance"]), (1, False, head, ["N", "S", "1"])]
    thead = "<table><thead><tr><td>A</td></tr><tr><td>B</td></tr></thead><tbody><tr><td>1</td></tr></tbody></table>"
    assert [(n, h, x) for n, h, x, _ in cells_of(spark, thead)] == [(-1, True, ["A B"]), (0, True, ["A B"]), (1, False, ["A B"])]
    none = "<table><tr><td>A</td></tr><tr><td>1</td></tr></table>"
    assert [(n, h, x) for n, h, x, _ in cells_of(spark, none)] == [(0, False, ["A"]), (1, False, ["A"])]


def test_registry_with_spans(spark):
    html = """<table><tr><th colspan=2>Participant</th><th rowspan=2>Shareholding</th><th rowspan=2>% of the total Issued Shares</th></tr><tr><th>ID</th><th>Name</th></tr>
<tr><td rowspan=2>B00001</td><td>A</td><td>1,000</td><td>10%</td></tr><tr><td>A, client account</td><td>7</td><td>1%</td></tr></table>"""
    got = pages.registry_snapshots(spark.createDataFrame([("1", "d", html)], "code string, query_date string, html string")).collect()
    assert {(r.participant_id, r.participant_name, r.shares, r.pct_of_issued) for r in got} == {("B00001", "A", 1000, 10.0), ("B00001", "A, client account", 7, 1.0)}


def test_issue_id_by_priority_of_links(spark):
    def found(html):
        return pages.page_metadata(spark.createDataFrame([(1, html)], "page_id long, html string"), ["page_id"]).first().issue_id

    assert found('<a href="x.asp?i=11">a</a><a href="price.asp?i=22">b</a><a href="cconchist.asp?o=1&i=33">c</a>') == "33"
    assert found('<a href="x.asp?i=11">a</a><a href="price.asp?i=22">b</a><a href="trades.asp?i=23">c</a>') == "22"
    assert found('<a href="x.asp?j=1">a</a><a href="x.asp?i=12">b</a><a href="z.asp?i=13">c</a>') == "12"
    assert found('<a href="x.asp?p=1&amp;i=1">other</a><a href="x.asp?p=1&amp;i=44">CCASS <i>holdings</i></a>') == "44"
    assert found('<a href="x.asp?p=1&amp;i=1">other</a>') is None and found("<p>issue id: 12345</p>") == "12345" and found(None) is None


def test_each_reader_parses_a_page_once(spark):
    df = spark.createDataFrame([("1", "d", "")], "code string, query_date string, html string")
    dated = df.withColumnRenamed("query_date", "date")
    plans = [pages.registry_snapshots(df), pages.holdings_pages(dated), pages.corporate_events(df, ["code"], "s"), pages.page_metadata(df, ["code"])]
    plans += [pages.section_rows(pages.html_tables(df, ["code"]), ["code"], x) for x in pages.SECTION_FIELDS]
    assert all(p._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1 for p in plans)
