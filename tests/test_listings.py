"""Listings over several pages: plain rows cut by their tags, places of columns, row numbers that go on."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from shareflow.functions.columns import header_index, place
from shareflow.operators.tables import forward_filled, numbered_rows
from shareflow.plans import source_queries
from shareflow.sources import pages

PARTS = [
    "<tr><td>a</td><td>b  c</td></tr>", "<tr><td></td></tr>\n", '<tr><td><a href="x?i=1">l</a></td><td>z</td></tr>', "<tr><th>h</th><td>d</td></tr>", '<tr><td rowspan="2">s</td><td>t</td></tr>', "<table>", "</table>", "<thead>", "</thead>", "<td>", "</td>", "text", "a &amp; b",
    "&am", "<h3>", "</h3>", "<script>", "</script>", "<!--", "-->", "<title>", "</title>", '<span class="info">', "</span>", "<tr>", "</tr>", "<tr><td>\xa0é\n</td></tr>", '<tr><td class="c">k</td></tr>', "<p>",
]


def _rows(page, plain):
    out = []
    p = pages._Page(lambda t, n, is_header, filled: out.append((t.number, t.heading, n, is_header, t.header, [(c.text, c.href, c.css, c.code, c.full) for c in filled])))
    if not plain:
        p.read = p.feed
    for _ in pages._fed(p, pa.scalar(page)):
        pass
    return out


def test_plain_rows_are_read_like_others():
    rng = random.Random(5)
    weights = [12, 6, 6, *[1] * (len(PARTS) - 3)]
    for _ in range(4000):
        page = "<table>" * rng.randint(0, 1) + "".join(rng.choices(PARTS, weights, k=rng.randint(1, 30)))
        assert _rows(page, True) == _rows(page, False), page


def test_places_agree_with_the_column(spark):
    headers = [["Participant ID", "Name of X", "Share-holding", "% of shareholding"], [" # ", "%", ""], [None, "CCASS  ID"], []]
    wants = [["participant id", "ccass id"], ["#"], ["%", "percent"], ["shareholding", "share holding"]]
    df = spark.createDataFrame([(h,) for h in headers], "h array<string>")
    got = df.select(*(header_index(F.col("h"), w).cast("int") for w in wants)).collect()
    assert [list(r) for r in got] == [[place(h, w) for w in wants] for h in headers]
    assert place(headers[0], ["shareholding"], "%") is None


def test_a_listing_goes_on_on_further_pages(spark):
    n = 2 * source_queries.PAGE_ROWS + 7
    rows = spark.range(n).selectExpr("'c' as code", "id as k", "concat('P', id) as name")
    made = source_queries.made_pages(rows, ["code"], ["K", "Name"], ["k", "name"], ["k"])
    assert {r.page: r.html.count("<tr>") for r in made.collect()} == {0: source_queries.PAGE_ROWS + 1, 1: source_queries.PAGE_ROWS + 1, 2: 8}
    read = source_queries.continued(pages.html_tables(made, ["code", "page"])).collect()
    assert sorted((r.row_no, r.cells[1].text) for r in read) == [(0, "Name"), *((k + 1, f"P{k}") for k in range(n))]


def test_numbers_by_runs(spark):
    df = spark.range(500).selectExpr("cast(id % 3 as string) as code", "cast(id * 7 % 11 as int) as day", "id").localCheckpoint()
    got = numbered_rows(df, ["code"], ["day"], ["id"], "no", "of_day").orderBy("code", "no").collect()
    for code in "012":
        mine = [(r.day, r.id) for r in got if r.code == code]
        assert mine == sorted(mine) and [r.no for r in got if r.code == code] == list(range(1, len(mine) + 1))
    assert all((r.of_day == 1) == (r.id == min(x.id for x in got if (x.code, x.day) == (r.code, r.day))) for r in got)


def test_filled_by_blocks(spark):
    rows = [(k % 2, k, None if k % 37 or k < 60 else f"v{k}") for k in range(400)] + [(None, 3, "n"), (None, 90, " ")]
    df = spark.createDataFrame(rows, "code int, seq int, v string").localCheckpoint()
    of = lambda x: sorted(map(tuple, x.collect()), key=str)
    for block in (1, 16, 1000):
        assert of(forward_filled(df, "v", ["code"], "seq", block)) == of(forward_filled(df, "v", ["code"], "seq"))
