"""Holdings that go on over several pages are numbered along the whole listing."""

import pytest

from shareflow.plans import source_queries
from shareflow.plans.queries import ORACLES, QUERIES
from shareflow.sources import pages
from tests.oracle import HAVE_DATA, agrees


@pytest.mark.skipif(not HAVE_DATA, reason="the driver's tables aren't here")
def test_ranks_go_on_on_further_pages(spark, monkeypatch):
    monkeypatch.setattr(source_queries, "PAGE_ROWS", 2)
    assert agrees(spark, QUERIES["section_holdings"], ORACLES["section_holdings"])


def test_rows_without_a_rank_take_their_place(spark):
    body = "".join(f"<tr><td>{n}</td><td>{k}</td><td>1</td></tr>" for k, n in enumerate(["A", " ", "B"]))
    made = spark.createDataFrame([(p, f"<table><tr><th>Participant</th><th>Holding</th><th>Stake %</th></tr>{body}</table>") for p in (0, 1)], "page int, html string")
    rows = lambda **x: sorted((r.page, r.participant_name, r["rank"]) for r in pages.section_rows(pages.html_tables(made, ["page"]), ["page"], "Holdings", **x).collect())
    assert rows() == [(0, "A", 1), (0, "B", 3), (1, "A", 1), (1, "B", 3)]
    assert rows(place=source_queries.in_listing()) == [(0, "A", 1), (0, "B", 3), (1, "A", 1001), (1, "B", 1003)]
