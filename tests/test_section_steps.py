"""The steps from a page's table to a section's rows: which table, which columns, ranks, dates and the rows that go."""

from shareflow.sources import pages


def _table(*rows):
    cells = lambda tag, row: "".join(f"<{tag}>{c}</{tag}>" for c in row)
    return "<table><tr>" + cells("th", rows[0]) + "</tr>" + "".join(f"<tr>{cells('td', r)}</tr>" for r in rows[1:]) + "</table>"


def _rows(spark, html, section, *fields, **more):
    tables = pages.html_tables(spark.createDataFrame([(1, html)], "page_id long, html string"), ["page_id"])
    return [tuple(r[f] for f in fields) for r in pages.section_rows(tables, ["page_id"], section, **more).orderBy("row_no").collect()]


def test_ranks_of_holdings(spark):
    given = _table(["Rank", "Participant", "Holding", "Stake %"], [4, "A", 9, 2], ["", "B", 8, 1])
    assert _rows(spark, given, "Holdings", "participant_name", "rank") == [("A", 4.0), ("B", None)]
    places = _table(["Participant", "Holding", "Stake %"], ["A", 9, 2], ["", 5, 1], ["B", 8, 1])
    assert _rows(spark, places, "Holdings", "participant_name", "rank") == [("A", 1.0), ("B", 3.0)]


def test_columns_by_preference(spark):
    held = _table(["Participant", "Holding", "Stake %", "Cumulative holding", "Cumulative %"], ["A", 9, 2, 900, 20])
    assert _rows(spark, held, "Holdings", "cumulative") == [(20.0,)]
    delta = _table(["Participant", "Change", "Holding", "Stake Δ %", "Stake %"], ["A", 5, 9, 0.5, 2])
    assert _rows(spark, delta, "Changes", "change", "change_pct") == [(5.0, 0.5)]
    alone = _table(["Participant", "Change", "Holding", "Stake %"], ["A", 5, 9, 2])
    assert _rows(spark, alone, "Changes", "change", "change_pct") == [(5.0, 5.0)]
    shares = _table(["Date", "Participant", "Holding change"], ["2024-01-05", "A", 5])
    assert _rows(spark, shares, "Big Changes", "change_shares", "change_pct") == [(5.0, None)]
    prices = _table(["Date", "Close", "Vol", "Amount", "Average price"], ["2024-01-05", 1.5, 10, 15, 1.4])
    assert _rows(spark, prices, "Price History", "volume", "turnover", "vwap") == [(10.0, 15.0, 1.4)]


def test_a_table_without_a_needed_column_has_no_rows(spark):
    # the last column is the one that is needed
    whole = {"Holdings": ["Participant", "Holding", "Stake %"], "Changes": ["Participant", "Change"], "Big Changes": ["Participant", "Change %", "Date"], "Concentration": ["Date", "Top 5 %", "Top 10 %"], "Price History": ["Date", "Volume", "Close"]}
    for section, header in whole.items():
        row = ["2024-01-05"] * len(header)
        assert _rows(spark, _table(header, row), section, "row_no", chosen={section: 0}) == [(1,)], section
        assert _rows(spark, _table([*header[:-1], "Note"], row), section, "row_no", chosen={section: 0}) == [], section


def test_a_table_without_rows_is_not_chosen(spark):
    header = ["Participant", "Holding", "Stake %"]
    html = _table(header) + _table(header, ["A", 9, 2])
    assert _rows(spark, html, "Holdings", "participant_name") == [("A",)]
    tables = pages.html_tables(spark.createDataFrame([(1, html)], "page_id long, html string"), ["page_id"])
    assert [r.table_no for r in pages.section_tables(tables, ["page_id"]).filter("section = 'Holdings'").collect()] == [1]


def test_dates_are_taken_from_rows_that_go(spark):
    html = _table(["Date", "Participant", "Change %"], ["2024-01-05", "", ""], ["", "A", 12], ["2024-01-06", "B", 11])
    assert [(n, str(d)) for n, d in _rows(spark, html, "Big Changes", "participant_name", "date")] == [("A", "2024-01-05"), ("B", "2024-01-06")]


def test_rows_without_any_value_go(spark):
    html = _table(["Date", "Top 5 %", "Top 10 %"], ["2024-01-05", 1, 2], ["", "", ""], ["", 3, ""])
    assert _rows(spark, html, "Concentration", "top5") == [(1.0,), (3.0,)]
