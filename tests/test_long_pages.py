"""Pages longer than what is parsed at a time: the same rows, and memory that doesn't follow the page's length."""

import tracemalloc

import pyarrow as pa

from shareflow.sources import pages


def _long(n):
    body = "".join(f'<tr><td rowspan="2">{k} &amp; é</td><td><a href="x?i={k}">l</a></td></tr><tr><td>{k}b</td></tr>' for k in range(n))
    return f"<h3>Long</h3><table><thead><tr><th>A</th><th>B</th></tr></thead>{body}</table><table><tr><td>after</td></tr></table>"


def test_rows_of_a_page_in_many_pieces(spark):
    df = spark.createDataFrame([(1, _long(9000)), (2, None), (3, "<table><tr><td>short")], "page_id long, html string")
    got = {(r.page_id, r.table_no, r.row_no): [(c.text, c.href) for c in r.cells] for r in pages.html_tables(df, ["page_id"]).collect()}
    wanted = {(1, 0, 0): [("A", None), ("B", None)], (1, 1, 0): [("after", None)], (3, 0, 0): [("short", None)]}
    for k in range(9000):
        wanted |= {(1, 0, 2 * k + 1): [(f"{k} & é", None), ("l", f"x?i={k}")], (1, 0, 2 * k + 2): [(f"{k} & é", None), (f"{k}b", None)]}
    assert got == wanted


def test_memory_does_not_follow_the_length_of_a_page():
    def peak(n):
        page, keys, rows = pa.scalar(_long(n)), pa.RecordBatch.from_pydict({"k": [1]}), pages._Rows()
        seen = 0
        tracemalloc.start()
        for _ in pages._fed(pages._Page(rows.add), page):
            if rows.ends[-1] >= pages._CELLS:
                seen += rows.batch(keys).num_rows
        seen += rows.batch(keys).num_rows
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert seen == 2 * n + 2
        return most

    assert peak(40_000) < 1.3 * peak(20_000)
