"""Web pages into rows: one Python job takes pages apart, everything after it is SQL.

`html_tables` returns a row per table row of every page, its cells laid out on the table's grid. The readers below choose
a page's table by windows over its rows (so each page is parsed once), find its columns by their headers and clean the
cells. Pages are parsed by the standard library's tolerant parser; a page without a table, with null or broken HTML, gives
no rows.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Callable, Iterator
from functools import reduce
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shareflow.functions import scalars
from shareflow.functions.columns import cell, header_index, place
from shareflow.functions.rules import reason_tags
from shareflow.operators.tables import first_rows, spread

_CELL = pa.struct([("text", pa.string()), ("href", pa.string()), ("css", pa.string()), ("code", pa.string()), ("full", pa.string())])
_ROW_FIELDS = [
    ("table_no", pa.int32()), ("table_css", pa.string()), ("box_id", pa.string()), ("heading", pa.string()), ("row_no", pa.int32()),
    ("is_header", pa.bool_()), ("header", pa.list_(pa.string())), ("cells", pa.list_(_CELL)),
]
ROWS_DDL = (
    "table_no int, table_css string, box_id string, heading string, row_no int, is_header boolean, header array<string>,"
    " cells array<struct<text:string,href:string,css:string,code:string,full:string>>"
)
_VOID = {"br", "img", "hr", "input", "meta", "link", "col", "area", "base", "source", "wbr"}
_NO_CELLS = ("script", "style", "noscript", "title", "h2", "h3", "span")  # tags inside which text isn't, or isn't only, a cell's
_APART = {"br", "p", "div", "td", "th", "tr", "li"}  # tags that part words


def _squeezed(parts: list[str]) -> str:
    return " ".join("".join(parts).replace("\xa0", " ").split())


def _span(value: str | None, most: int) -> int:
    """A span as HTML reads it: 1 unless it is a number; 0 (for rows: to the end of the table) stays."""
    return min(int(value), most) if value and value.strip().isascii() and value.strip().isdigit() else 1


class _Cell:
    __slots__ = ("text", "href", "css", "code", "full", "th", "head", "wide", "high")

    def __init__(self, attrs: dict[str, str], th: bool, head: bool) -> None:
        self.text, self.code, self.full = [], [], []
        self.href, self.css, self.th, self.head = None, attrs.get("class"), th, head
        self.wide, self.high = _span(attrs.get("colspan"), 1000), _span(attrs.get("rowspan"), 65534)

    @classmethod
    def plain(cls, written: str, head: bool) -> _Cell:
        """A cell of _PLAIN_CELL, without its tags."""
        c = cls({}, False, head)
        if written.startswith("<a "):
            c.href, text = written[9:-4].split('">', 1)
            c.text.append(text)
        else:
            c.text.append(written)
        return c

    def close(self) -> None:
        self.text, self.code, self.full = _squeezed(self.text), _squeezed(self.code) if self.code else "", _squeezed(self.full) if self.full else ""


#: More rows than any table has: how far a span of 0 rows reaches.
_TO_THE_END = 1 << 62


class _Table:
    """A table that is being read: rows are laid out by column and given to `emit` as soon as they are complete.

    Only the row being read, the cells that still hang into it and the header band are held. The band is known at the first
    row that isn't of it: leading rows of a thead, else all leading rows of header cells, else the first row.
    """

    def __init__(self, number: int, css: str | None, box: str | None, heading: str, emit: Callable[[_Table, int, bool, list[_Cell]], None]) -> None:
        self.number, self.css, self.box, self.heading, self.emit = number, css, box, heading, emit
        self.row: list[_Cell] | None = None
        self.hanging: dict[int, tuple[int, _Cell]] = {}  # column: rows that a cell from above still covers
        self.band: list[list[_Cell]] = []
        self.by = "th"  # what its rows have in common
        self.header: list[str] | None = None
        self.places: list[int | None] | None = None  # of columns that are looked for by the header
        self.row_no = 0

    def end_row(self) -> None:
        """The row is complete; one without cells counts for nothing."""
        if self.row:
            for c in self.row:
                c.close()
            filled = self._laid_out(self.row)
            if self.header is not None:
                self._give(filled)
            elif not self.band:
                self.band.append(filled)
                self.by = "head" if all(c.head for c in filled) else "th"
                if not all(getattr(c, self.by) for c in filled):
                    self.end_band()
            elif all(getattr(c, self.by) for c in filled):
                self.band.append(filled)
            else:
                self.end_band()
                self._give(filled)
        self.row = None

    def end_band(self) -> None:
        """Name the columns by the band, a cell that spans rows once, and give its rows: the last is number 0."""
        columns = [[r[k] for r in self.band if k < len(r)] for k in range(max(map(len, self.band), default=0))]
        self.header = [" ".join(c.text for n, c in enumerate(cells) if c.text and all(c is not d for d in cells[:n])) for cells in columns]
        for n, filled in enumerate(self.band, 1 - len(self.band)):
            self.emit(self, n, len(self.band) > 1 or all(c.th for c in filled), filled)
        self.band = []

    def end(self) -> None:
        self.end_row()
        if self.band:
            self.end_band()

    def _give(self, filled: list[_Cell]) -> None:
        self.row_no += 1
        self.emit(self, self.row_no, all(c.th for c in filled), filled)

    def _laid_out(self, row: list[_Cell]) -> list[_Cell]:
        """A cell fills all places that its spans cover, and later cells of a row move right of them."""
        if not self.hanging and all(c.wide == 1 and c.high == 1 for c in row):
            return row
        filled: list[_Cell] = []
        below: dict[int, tuple[int, _Cell]] = {}

        def hang() -> None:
            while (from_above := self.hanging.pop(len(filled), None)) is not None:
                left, cell = from_above
                if left > 1:
                    below[len(filled)] = left - 1, cell
                filled.append(cell)

        for cell in row:
            hang()
            for _ in range(max(cell.wide, 1)):
                self.hanging.pop(len(filled), None)  # where a wide cell meets one from above, the wide one counts
                if cell.high != 1:
                    below[len(filled)] = (cell.high or _TO_THE_END) - 1, cell
                filled.append(cell)
        hang()
        self.hanging = below
        return filled


#: Cells without attributes that hold a text or a link alone, and runs of rows of nothing but these, before another such row.
_PLAIN_CELL = r'<td>(?:[^<&]*|<a href="[^"<&]*">[^<&]*</a>)</td>'
_PLAIN_ROWS = re.compile(rf"(?:<tr>(?:{_PLAIN_CELL})+</tr>\s*)+(?=<tr>)")


class _Page(HTMLParser):
    """Gives out the rows of a page's tables with their headings and enclosing ids; with texts=True collects its title,
    headings, notice, links and visible text too."""

    def __init__(self, emit: Callable[[_Table, int, bool, list[_Cell]], None], texts: bool = False) -> None:
        super().__init__(convert_charrefs=True)
        self.emit, self.texts = emit, texts
        self.tables = 0
        self.found: dict[str, list[str]] = {}
        self.visible: list[str] = []
        self.open: list[tuple[str, dict]] = []  # elements that are open
        self.count: Counter[str] = Counter()  # of them, by tag
        self.stack: list[_Table] = []  # tables that are open
        self.heading: list[str] = []
        self.links: list[tuple[str, list[str]]] = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in _APART:
            self._text(" ")
        if tag == "table":
            box = next((x["id"] for _, x in reversed(self.open) if x.get("id")), None)
            self.stack.append(_Table(self.tables, a.get("class"), a.get("id") or box, _squeezed(self.heading), self.emit))
            self.tables += 1
        elif tag == "tr" and self.stack:
            self.stack[-1].end_row()
            self.stack[-1].row = []
        elif tag in ("td", "th") and self.stack:
            if self.stack[-1].row is None:
                self.stack[-1].row = []
            self.stack[-1].row.append(_Cell(a, tag == "th", self.count["thead"] > 0))
        if tag == "a" and a.get("href") is not None:
            if self.texts:
                self.links.append((a["href"], []))
            if (c := self._cell()) is not None and c.href is None:
                c.href = a["href"]
        if tag in ("h2", "h3"):
            self.heading = []
        if self.texts and tag in ("h1", "h2", "h3", "title"):
            self.found.setdefault(tag, [])
        if tag not in _VOID:
            self.open.append((tag, a))
            self.count[tag] += 1

    def handle_endtag(self, tag):
        if self.count[tag]:
            while True:
                last, _ = self.open.pop()
                self.count[last] -= 1
                if last == tag:
                    break
        if tag == "table" and self.stack:
            self.stack.pop().end()

    def handle_data(self, data):
        self._text(data)

    def read(self, piece: str) -> None:
        """feed() for a piece that ends before a tag; runs of plain rows are cut by their tags, which gives the same rows."""
        start = 0
        if not self.texts:
            for run in _PLAIN_ROWS.finditer(piece):
                self.feed(piece[start : run.start()])
                start = run.start()
                if self._takes_rows():
                    self._plain_rows(run[0])
                    start = run.end()
        self.feed(piece[start:])

    def _takes_rows(self) -> bool:
        """Whether what comes next is a row of the table that is open, and its texts are cells' texts and nothing else."""
        return bool(self.stack) and not self.rawdata and self.cdata_elem is None and not any(self.count[t] for t in _NO_CELLS)

    def _plain_rows(self, run: str) -> None:
        """The rows of a run; the last one stays open, as it does when a row's end has been read."""
        table, head = self.stack[-1], self.count["thead"] > 0
        for row in run.rstrip()[8:-10].split("</td></tr>"):
            table.end_row()
            # what stands between rows is white space
            table.row = [_Cell.plain(c, head) for c in row.lstrip().removeprefix("<tr><td>").split("</td><td>")]

    def finish(self) -> None:
        """End the tables that the page leaves open."""
        while self.stack:
            self.stack.pop().end()

    def _cell(self) -> _Cell | None:
        return self.stack[-1].row[-1] if self.stack and self.stack[-1].row else None

    def _text(self, data: str) -> None:
        count = self.count
        if count["script"] or count["style"] or count["noscript"]:
            return
        if count["title"]:
            if self.texts:
                self.found["title"].append(data)
            return
        if count["h2"]:
            self.heading.append(data)
        if count["h3"]:
            self.heading.append(data)
        if self.texts:
            self.visible.append(data)
            if count["a"] and self.links:
                self.links[-1][1].append(data)
            for tag in ("h1", "h2", "h3"):
                if count[tag]:
                    self.found[tag].append(data)
            if any("letterbox" in a.get("class", "").split() for _, a in self.open):
                self.found.setdefault("notice", []).append(data)
        if (count["td"] or count["th"]) and (c := self._cell()) is not None:
            c.text.append(data)
            if count["span"]:
                spans = [a.get("class", "") for t, a in self.open if t == "span"]
                if "info" in spans:
                    (c.full if len(spans) > spans.index("info") + 1 else c.code).append(data)


#: Bytes of a page that are decoded and parsed at a time, and cells of a batch of rows that goes out.
_PIECE, _CELLS = 1 << 18, 1 << 16


def _pieces(page: pa.StringScalar) -> Iterator[str]:
    """A page's text in pieces that end before a tag, about _PIECE bytes each; nothing for null."""
    whole = memoryview(page.as_buffer()) if page.is_valid else memoryview(b"")
    start = 0
    while start < len(whole):
        size, cut = _PIECE, 0
        while cut <= 0:
            part = bytes(whole[start : start + size])
            cut = len(part) if start + size >= len(whole) else part.rfind(b"<")
            size *= 2
        yield part[:cut].decode()
        start += cut


def _fed(parser: _Page, page: pa.StringScalar) -> Iterator[None]:
    """Parse a page; control comes back after every piece of it."""
    try:
        for piece in _pieces(page):
            parser.read(piece)
            yield
        parser.close()
    except AssertionError:  # the parser gives up on a malformed marked section: what it has read so far counts
        pass
    parser.finish()
    yield


class _Rows:
    """Rows of tables as columns, until there are enough of them for a batch."""

    def __init__(self, places: dict[str, tuple[list[str], str]] | None = None) -> None:
        self.page, self.wanted = 0, places or {}
        self.clear()

    def clear(self) -> None:
        self.source, self.rows = [], {n: [] for n, _ in _ROW_FIELDS[:-1]}
        self.cells, self.ends = {f.name: [] for f in _CELL}, [0]
        self.places = {n: [] for n in self.wanted}

    def add(self, table: _Table, row_no: int, is_header: bool, filled: list[_Cell]) -> None:
        self.source.append(self.page)
        for column, v in zip(self.rows.values(), (table.number, table.css, table.box, table.heading, row_no, is_header, table.header), strict=True):
            column.append(v)
        if self.wanted:
            if table.places is None:
                table.places = [place(table.header, *want) for want in self.wanted.values()]
            for column, v in zip(self.places.values(), table.places, strict=True):
                column.append(v)
        for name, column in self.cells.items():
            column.extend([getattr(c, name) for c in filled])
        self.ends.append(self.ends[-1] + len(filled))

    def batch(self, keys: pa.RecordBatch) -> pa.RecordBatch:
        """The rows held, each with the keys of its page; none are held afterwards."""
        cells = pa.StructArray.from_arrays([pa.array(v, pa.string()) for v in self.cells.values()], fields=list(_CELL))
        listed = pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), cells)
        columns = [pa.array(self.rows[n], t) for n, t in _ROW_FIELDS[:-1]]
        found = [pa.array(v, pa.int32()) for v in self.places.values()]
        out = pa.RecordBatch.from_arrays([*keys.take(pa.array(self.source, pa.int64())).columns, *columns, listed, *found], [*keys.schema.names, *self.rows, _ROW_FIELDS[-1][0], *self.places])
        self.clear()
        return out


def html_tables(pages: DataFrame, keys: list[str], html: str = "html", places: dict[str, tuple[list[str], str]] | None = None) -> DataFrame:
    """The keys and a row per table row: numbers of table and row, the columns' names as header, and cells by column.

    Spans fill all their places. A table's header is a band of rows (leading rows of a thead, else all leading rows of header
    cells, else the first row), whose texts are joined by column; its last row is number 0, those above have negative
    numbers, and the rows below it count from 1. A cell has its text, first link, class, and the outer and inner text of an
    info span. Rows without cells are left out. A page is read in pieces and its rows go out in batches of bounded size, so
    the memory of Python doesn't grow with the length of a page or of its tables, only with the width of a row.
    places: columns to add, with what place() takes: the place of a column of the table, found once a table.
    """
    places = places or {}

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(places)
        for batch in batches:
            named, column = batch.select(keys), batch.column(html)
            for k in range(batch.num_rows):
                rows.page = k
                for _ in _fed(_Page(rows.add), column[k]):
                    if rows.ends[-1] >= _CELLS:
                        yield rows.batch(named)
            yield rows.batch(named)

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keys).schema)
    found = "".join(f", {n} int" for n in places)
    return pages.select(*keys, html).mapInArrow(one, f"{types}, {ROWS_DDL}{found}")


#: Fixed value: the column by which a table of holder types is known.
HOLDER_TYPE = "Type of holder"


class _Holders:
    """The body rows of a page's first table with a column HOLDER_TYPE, by column name."""

    def __init__(self) -> None:
        self.tables: dict[int, list[dict[str, str]]] = {}

    def add(self, table: _Table, row_no: int, is_header: bool, filled: list[_Cell]) -> None:
        if HOLDER_TYPE in table.header:
            rows = self.tables.setdefault(table.number, [])
            if row_no > 0:
                rows.append({h: c.text for h, c in zip(table.header, filled, strict=False)})

    def rows(self) -> list[dict[str, str]]:
        return self.tables[min(self.tables)] if self.tables else []


#: What page_texts reads from a page, and the characters of texts and links of a batch that goes out.
_TEXT_FIELDS = {
    "title": pa.string(), "h1": pa.string(), "h2": pa.string(), "notice": pa.string(), "text": pa.string(),
    "links": pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())])), "holders": pa.list_(pa.map_(pa.string(), pa.string())),
}
_TEXT_SIZE = 1 << 24


def as_written(html: Column) -> Column:
    """A page whose texts, once parsed, have their character references as the page writes them, ended by `;` or not."""
    return F.replace(html, F.lit("&"), F.lit("&amp;"))


def page_texts(pages: DataFrame, keys: list[str], html: str = "html", limit: int | None = None) -> DataFrame:
    """The keys, title, h1, h2 (first headings' text), notice, the visible text (its first `limit` characters if given), links
    (href and text, in order), and the body rows of the first table with a column HOLDER_TYPE, by column name."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named, column = batch.select(keys), batch.column(html)
            values, size, start = {n: [] for n in _TEXT_FIELDS}, 0, 0
            for k in range(batch.num_rows):
                holders = _Holders()
                p = _Page(holders.add, texts=True)
                deque(_fed(p, column[k]), maxlen=0)
                text = _squeezed(p.visible)[:limit]
                found = [_squeezed(p.found[n]) if n in p.found else None for n in ("title", "h1", "h2", "notice")]
                links = [{"href": h, "text": _squeezed(t)} for h, t in p.links]
                for name, v in zip(values, [*found, text, links, holders.rows()], strict=True):
                    values[name].append(v)
                size += len(text) + sum(len(x["href"]) + len(x["text"]) for x in links)
                if size >= _TEXT_SIZE or k == batch.num_rows - 1:
                    arrays = [pa.array(values[n], t) for n, t in _TEXT_FIELDS.items()]
                    yield pa.RecordBatch.from_arrays([*named.slice(start, k + 1 - start).columns, *arrays], [*keys, *values])
                    values, size, start = {n: [] for n in _TEXT_FIELDS}, 0, k + 1

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keys).schema)
    return pages.select(*dict.fromkeys([*keys, html])).mapInArrow(one, f"{types}, title string, h1 string, h2 string, notice string, text string, links array<struct<href:string,text:string>>, holders array<map<string,string>>")


def _texts() -> Column:
    return F.transform("cells", lambda c: c["text"])


def _body(tables: DataFrame) -> DataFrame:
    return tables.filter("row_no > 0 and not is_header")


def _at(index: str) -> Column:
    """The text of the cell at a place, which is clean as it comes from a page; null for an empty one."""
    return F.nullif(cell(F.col("cells"), F.col(index))["text"], F.lit(""))


def _largest(tables: DataFrame, keys: list[str], good: Column) -> DataFrame:
    """Rows of the table of each page with the most good rows (the first of equals).

    Both windows work in the partitions of one shuffle by page.
    """
    counted = spread(tables, *keys).withColumn("_good", F.count_if(good).over(Window.partitionBy(*keys, "table_no")))
    best = F.max(F.when(F.col("_good") > 0, F.struct("_good", -F.col("table_no")))).over(Window.partitionBy(*keys))
    return counted.withColumn("_best", best).filter(-F.col("table_no") == F.col("_best")["col2"]).drop("_good", "_best")


def registry_snapshots(pages: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Participants' holdings of registry pages (code, query_date, html, or other keys): ids with a digit, numbers cleaned."""
    keys = keys or ["code", "query_date"]
    rows = html_tables(pages, keys, places={"_id": (["participant id", "ccass id"], ""), "_name": (["participant name", "name of"], ""), "_shares": (["shareholding"], "%"), "_pct": (["%", "percent", "issued"], "")})
    known = _body(rows.filter("_id is not null and _name is not null and _shares is not null")).select(
        *keys,
        "table_no",
        _at("_id").alias("participant_id"),
        _at("_name").alias("participant_name"),
        scalars.whole_number(cell(F.col("cells"), F.col("_shares"))["text"]).alias("shares"),
        scalars.percent(cell(F.col("cells"), F.col("_pct"))["text"]).alias("pct_of_issued"),
    )
    good = F.coalesce(F.col("participant_id").rlike(r"\d") & F.col("participant_name").isNotNull(), F.lit(False))
    return _largest(known, keys, good).filter(good).drop("table_no")


def holdings_pages(pages: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Holdings of historical pages (code, date, html, or other keys): the table with the most valid ids, its rows with one."""
    keys = keys or ["code", "date"]
    rows = html_tables(pages, keys, places={"_id": (["ccass id", "participant id", "id"], ""), "_name": (["participant", "name"], ""), "_holding": (["holding", "shares"], ""), "_stake": (["stake %", "stake", "%"], "")})
    known = _body(rows.filter("_id is not null and _holding is not null")).select(
        *keys, "table_no", F.upper(_at("_id")).alias("participant_id"), _at("_name").alias("participant_name"), scalars.whole_number(cell(F.col("cells"), F.col("_holding"))["text"]).alias("shares"), scalars.percent(cell(F.col("cells"), F.col("_stake"))["text"]).alias("stake_pct")
    )
    good = scalars.is_participant_id(F.col("participant_id"))
    return _largest(known, keys, good).filter(good).drop("table_no")


# Part of a header and the field it names, in order.
EVENT_HEADERS = [("announced", "announced"), ("year", "year_end"), ("type", "type"), ("amount", "amount"), ("value", "value_in_quote_ccy"), ("new", "new_old"), ("ex-date", "ex_date"), ("ex date", "ex_date"), ("exdate", "ex_date"), ("distri", "distribution"), ("note", "notes")]


def header_key(c: Column) -> Column:
    """The field that a header names, else the header in snake case."""
    plain = F.lower(scalars.clean_text(c))
    out = None
    for needle, key in EVENT_HEADERS:
        out = F.when(plain.contains(needle), key) if out is None else out.when(plain.contains(needle), key)
    snake = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return out.otherwise(F.when(snake == "", "column").otherwise(snake))


def corporate_events(pages: DataFrame, keys: list[str], site: str) -> DataFrame:
    """Events of the first table whose header has `announced` and `type`, with the event's id and link."""
    rows = html_tables(pages, keys).withColumn("_names", F.lower(F.array_join("header", " "))).filter(F.col("_names").contains("announced") & F.col("_names").contains("type"))
    first = spread(rows, *keys).withColumn("_first", F.min("table_no").over(Window.partitionBy(*keys))).filter("table_no = _first").drop("_first")
    body = _body(first).withColumn("_keys", F.transform("header", header_key))
    by_key = lambda k: F.nullif(scalars.clean_text(cell(_texts(), F.nullif(F.array_position("_keys", F.lit(k)), F.lit(0).cast("long")))), F.lit("")).alias(k)
    link = F.try_element_at(F.filter(F.transform("cells", lambda c: c["href"]), lambda h: h.rlike(r"eventdets\.asp\?e=\d+")), F.lit(1))
    fields = dict.fromkeys(k for _, k in EVENT_HEADERS)
    out = body.select(*keys, "row_no", *(by_key(k) for k in fields), F.nullif(F.regexp_extract(link, r"e=(\d+)", 1), F.lit("")).alias("event_id"), scalars.absolute_link(link, site, "dbpub/").alias("event_details_url"))
    return out.filter(" or ".join(f"{k} is not null" for k in fields))


def officers(pages: DataFrame, keys: list[str], site: str) -> DataFrame:
    """Named persons of all officer tables, grouped by the heading above; a row without a name continues the one above and goes."""
    rows = _body(html_tables(pages, keys).filter(F.coalesce(F.array_contains(F.split("table_css", " "), "opltable"), F.lit(False))))
    place = {k: header_index(F.col("header"), [k]) for k in ("name", "age", "position", "from", "until", "sex")}
    rows = rows.withColumns({f"_{k}": v for k, v in place.items()})
    # the sex column has a symbol for a header, if any: it stands right of the name
    rows = rows.withColumn("_sex", F.coalesce("_sex", F.col("_name") + 1))
    person = cell(F.col("cells"), F.col("_name"))
    position = cell(F.col("cells"), F.col("_position"))
    is_info = position["code"] != ""
    out = rows.select(
        *keys,
        F.col("heading").alias("table_group"),
        "table_no",
        "row_no",
        scalars.first_int(F.try_element_at(_texts(), F.lit(1))).alias("rank"),
        F.nullif(scalars.clean_text(person["text"]), F.lit("")).alias("name"),
        F.nullif(F.regexp_extract(person["href"], r"positions\.asp\?p=(\d+)", 1), F.lit("")).alias("person_id"),
        F.when(person["href"].rlike(r"positions\.asp\?p=\d+"), scalars.absolute_link(person["href"], site, "dbpub/")).alias("person_url"),
        _at("_sex").alias("sex"),
        scalars.first_int(_at("_age")).alias("age"),
        F.nullif(F.when(is_info, position["code"]).otherwise(position["text"]), F.lit("")).alias("position_code"),
        F.nullif(F.when(is_info, position["full"]), F.lit("")).alias("position"),
        _at("_from").alias("from_date"),
        _at("_until").alias("until_date"),
    )
    return out.filter("name is not null").withColumn("is_current", F.col("until_date").isNull())


def managers(pages: DataFrame, keys: list[str]) -> DataFrame:
    """One row per manager table: cells are told apart by their class."""
    rows = html_tables(pages, keys).filter(F.coalesce(F.array_contains(F.split("table_css", " "), "ggintro"), F.lit(False)))
    cells = rows.select(*keys, "table_no", "row_no", F.explode("cells").alias("c"))
    of = lambda css: F.min_by(F.when(F.col("c.css") == css, scalars.clean_text(F.col("c.text"))), F.when(F.col("c.css") == css, F.col("row_no")))
    one = cells.groupBy(*keys, "table_no").agg(*(of(c).alias(c) for c in ("title", "jobs", "date", "intro", "salary", "mainintro"))).filter("title <> ''")
    intro, tenure = scalars.person_intro(F.coalesce("intro", F.lit(""))), scalars.tenure(F.coalesce("date", F.lit("")))
    return one.select(
        *keys,
        "table_no",
        F.col("title").alias("name"),
        F.nullif("jobs", F.lit("")).alias("positions"),
        *(tenure[x].alias(x) for x in ("tenure_from", "tenure_to", "is_current")),
        *(intro[x].alias(x) for x in ("sex", "age", "education")),
        scalars.dash_to_null(F.regexp_replace("salary", "报酬[：:]", "")).alias("salary"),
        F.nullif("mainintro", F.lit("")).alias("biography"),
    )


def _float(i: int) -> Column:
    return F.regexp_replace(scalars.dash_to_null(F.try_element_at(_texts(), F.lit(i))), ",", "").try_cast("double")


def _plain(i: int) -> Column:
    return scalars.dash_to_null(F.try_element_at(_texts(), F.lit(i)))


ISO = r"^\d{4}-\d{2}-\d{2}"


def share_changes(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the share-change box with a date in the first of at least four cells."""
    rows = html_tables(pages, keys).filter("box_id = 'change' or heading like '%股本变化%'").filter((F.size("cells") >= 4) & F.try_element_at(_texts(), F.lit(1)).rlike(ISO))
    out = rows.select(*keys, F.col("row_no").alias("seq"), _plain(1).alias("announce_date"), _float(2).alias("shares_million"), _plain(3).alias("reason"), _plain(4).alias("change_date"))
    return out.withColumns({"shares_approx": (F.col("shares_million") * 1_000_000).cast("bigint"), "reason_tags": reason_tags(F.col("reason"))})


def buybacks(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the buyback box with a date in the second of at least eight cells."""
    rows = html_tables(pages, keys).filter("box_id = 'purchase' or heading like '%股份回购%'").filter((F.size("cells") >= 8) & F.try_element_at(_texts(), F.lit(2)).rlike(ISO))
    return rows.select(
        *keys, F.col("row_no").alias("seq"), _plain(1).alias("announce_date"), _plain(2).alias("buyback_date"), _float(3).alias("amount_wan"), _float(4).alias("shares_wan"), _float(5).alias("high_price"), _float(6).alias("low_price"), _plain(7).alias("method"), _plain(8).alias("currency")
    )


def first_match(text: Column, patterns: list[str]) -> Column:
    """The first group of the first pattern that matches, in order, whatever the case."""
    plain = scalars.clean_text(text)
    return F.coalesce(*(F.nullif(F.trim(F.regexp_extract(plain, f"(?i){p}", 1)), F.lit("")) for p in patterns))


# What a link with an issue id leads to, from what tells most to what tells least, and words of a link that
# may stand for a security.
ISSUE_LINKS = [r"(choldings|chldchg|bigchangesissue|cconchist)\.asp\?", r"(totalreturn|dealings|trades|price|changes)", r""]
ISSUE_WORDS = ["ccass", "total return", "dealings", "securities"]


def issue_of_links(links: Column, html: Column) -> Column:
    """struct(issue_id, priority) of a page's links (an array of href and text): the id of the first link of the best kind.

    Kinds, in order: pages of holdings and changes, pages of trading and prices, any place of the page where an id stands,
    and links whose href or text has one of ISSUE_WORDS (ids behind an escaped `&` are found by these alone). Null without
    an id. A holdings link counts wherever its id stands among the parameters.
    """
    number = lambda h: F.regexp_extract(h, r"[?&]i=(\d+)", 1)
    words = lambda x: reduce(lambda a, b: a | b, (F.lower(F.concat_ws(" ", x["href"], x["text"])).contains(w) for w in ISSUE_WORDS))
    # as the page writes it: an escaped & begins no parameter
    plain = lambda x: F.contains(html, x["href"])
    kind = lambda x: F.when(plain(x) & x["href"].rlike(f"(?i){ISSUE_LINKS[0]}"), 1).when(plain(x) & x["href"].rlike(f"(?i){ISSUE_LINKS[1]}"), 2).when(plain(x), 3).when(words(x), 4)
    ranked = F.transform(links, lambda x, at: F.struct(kind(x).alias("priority"), at.alias("at"), number(x["href"]).alias("issue_id")))
    anywhere = F.array(F.struct(F.lit(3).alias("priority"), F.lit(2**31 - 1).alias("at"), F.regexp_extract(html, r"[?&]i=(\d+)", 1).alias("issue_id")))
    best = F.array_min(F.filter(F.concat(ranked, anywhere), lambda x: x["priority"].isNotNull() & (x["issue_id"] != "")))
    return F.when(best.isNotNull(), F.struct(best["issue_id"].alias("issue_id"), best["priority"].alias("priority")))


def _holder_value(words: list[str], column: str) -> Column:
    """The value of a column in the first row of a page's holder types whose type has one of the words."""
    kind = lambda m: F.lower(F.coalesce(F.try_element_at(m, F.lit(HOLDER_TYPE)), F.lit("")))
    rows = F.filter("holders", lambda m: reduce(lambda a, b: a | b, (kind(m).contains(w) for w in words)))
    return F.nullif(F.try_element_at(F.get(rows, F.lit(0)), F.lit(column)), F.lit(""))


def page_metadata(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """Names, ids and facts that pages state in links and text: organisation, issue, code, date, issued shares, notice.

    What the registry holds, its percentage and the shares outside come from the text, else from the rows of a table of
    holder types.
    """
    raw, text = F.col(html), F.col("text")
    org = first_match(raw, [r"(?:orgdata|officers|overlap|pay|advisers|docs)\.asp\?p=(\d+)"])
    # the page goes along for its links: a copy under a name of its own
    facts = page_texts(pages.withColumns({"org_id": org, "_html": raw}), [*keys, "org_id", "_html"], html)
    whole = lambda c: F.regexp_replace(c, ",", "").try_cast("bigint")
    total = first_match(text, [r"Total (?:number )?in CCASS[:\s]+([0-9,]+)", r"Total securities in CCASS[:\s]+([0-9,]+)"])
    share = first_match(text, [r"Total (?:number )?in CCASS.*?([0-9.]+%)", r"Stake in CCASS[:\s]+([0-9.]+%)"])
    outside = first_match(text, [r"(?:Securities )?not in CCASS[:\s]+([0-9,]+)"])
    stated = F.coalesce(share, F.nullif(scalars.percent_text(_holder_value(["total"], "Stake %")), F.lit("")))
    issue = facts.withColumn("_issue", issue_of_links(F.col("links"), F.col("_html")))
    return issue.select(
        *keys,
        "title",
        F.coalesce("h1", "title").alias("company_name"),
        F.col("h2").alias("page_name"),
        F.nullif("notice", F.lit("")).alias("shutdown_notice"),
        "org_id",
        F.coalesce("_issue.issue_id", first_match(F.col("_html"), [r"issue[_ ]?id[=: ]+(\d{4,8})"])).alias("issue_id"),
        first_match(text, [r"\bStock code[:\s]+(\d{4,5})", r"\bCode[:\s]+(\d{4,5})"]).alias("code"),
        scalars.parse_date(first_match(text, [r"holdings on (\d{4}-\d{2}-\d{2})", r"Shareholding Date\s*[:：]?\s*(\d{4}[/-]\d{1,2}[/-]\d{1,2})"])).alias("holdings_date"),
        whole(first_match(text, [r"Issued (?:shares|securities)\s*[:：]?\s*([0-9,]+)"])).alias("issued_shares"),
        whole(F.coalesce(total, _holder_value(["total"], "Holding"))).alias("total_in_registry"),
        scalars.numeric_percent(stated).alias("total_in_registry_pct"),
        whole(F.coalesce(outside, _holder_value(["not in ccass", "outside"], "Holding"))).alias("outside_registry"),
    )


def outbound_links(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """The keys and a row per link of a page, in order."""
    return pages.select(*keys, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*href=\"([^\"]*)\""), F.lit(1))).alias("link_no", "href"))


# Words that speak for a section's table, words it must have (one of each group), and the least score.
SECTION_WORDS = {
    "Holdings": ["participant", "name", "ccass id", "holding", "stake", "cumulative", "cumul stake", "name of ccass participant", "holding percentage", "cumulative percentage"],
    "Changes": ["participant", "name", "change", "holding", "stake", "holding after", "change in shares", "change %", "stake", "trading date", "volume", "turnover", "average price", "total securities in ccass"],
    "Big Changes": ["date", "participant", "change", "change %", "holding change"],
    "Concentration": ["date", "top 5", "top 10", "top 10 ncip", "stake in ccass"],
    "Price History": ["date", "close", "price", "volume", "turnover", "vwap"],
    "Company / orgdata": ["code", "listed", "hk main", "stock code", "name", "issue"],
}
SECTION_MUST = {
    "Holdings": [["participant", "name"], ["holding"], ["stake"]],
    "Changes": [["participant", "name"], ["change"]],
    "Big Changes": [["participant"], ["date"], ["change"]],
    "Concentration": [["date"], ["top 5", "top5"]],
    "Price History": [["date"], ["close", "price"]],
}
SECTION_LEAST = {"Company / orgdata": 2}


def section_score(text: Column, section: str) -> Column:
    score = F.lit(0)
    for word in SECTION_WORDS[section]:
        score = score + F.when(text.contains(word), 1).otherwise(0)
    for group in SECTION_MUST.get(section, []):
        has = F.lit(False)
        for word in group:
            has = has | text.contains(word)
        score = F.when(has, score).otherwise(0)
    return score


def _head_text(texts: Column) -> Column:
    """The header and the first five rows of a table as one normal text; texts: an array of (row_no, text)."""
    return scalars.normal_name(F.array_join(F.transform(F.array_sort(texts), lambda x: x["t"]), " "))


def _line(texts: Column) -> Column:
    return F.when(F.col("row_no") <= 5, F.struct("row_no", F.array_join(texts, " ").alias("t")))


def section_tables(tables: DataFrame, keys: list[str], chosen: dict[str, int] | None = None) -> DataFrame:
    """The table of each page and section: the best score over the header and five rows, at least 3 (2 for the company); or by choice."""
    # a table without rows below its header has nothing to be scored
    first = tables.groupBy(*keys, "table_no").agg(F.when(F.max("row_no") > 0, _head_text(F.collect_list(_line(_texts())))).otherwise("").alias("text"))
    choice = lambda s: F.lit((chosen or {}).get(s)).cast("int")
    scores = F.array(*(F.struct(F.lit(s).alias("section"), choice(s).alias("choice"), section_score(F.col("text"), s).alias("score"), F.lit(SECTION_LEAST.get(s, 3)).alias("least")) for s in SECTION_WORDS))
    long = first.select(*keys, "table_no", F.explode(scores).alias("s")).select(*keys, "table_no", "s.*")
    fits = long.filter("choice = table_no or (choice is null and score >= least)").withColumn("score", F.expr("if(choice is null, score, null)"))
    return first_rows(fits, [*keys, "section"], [F.desc("score"), F.asc("table_no")]).select(*keys, "section", "table_no", "score")


def section_of(tables: DataFrame, keys: list[str], section: str, chosen: dict[str, int] | None = None) -> DataFrame:
    """The rows of each page's table of a section, by the same choice, in one shuffle by page."""
    return _of_section(tables, keys, section, chosen, _texts())


def _of_section(tables: DataFrame, keys: list[str], section: str, chosen: dict[str, int] | None, texts: Column) -> DataFrame:
    """section_of() of rows whose cells have these texts. A table is scored once, at its topmost row."""
    if section in (chosen or {}):
        return tables.filter(F.col("table_no") == chosen[section])
    one = Window.partitionBy(*keys, "table_no")
    headed = spread(tables, *keys).withColumns({"_lines": F.collect_list(_line(texts)).over(one), "_top": F.min("row_no").over(one), "_end": F.max("row_no").over(one)})
    scored = headed.withColumn("_text", F.when((F.col("row_no") == F.col("_top")) & (F.col("_end") > 0), _head_text(F.col("_lines")))).withColumn("_score", section_score(F.col("_text"), section))
    best = F.max(F.when(F.col("_score") >= SECTION_LEAST.get(section, 3), F.struct("_score", -F.col("table_no")))).over(Window.partitionBy(*keys))
    return scored.withColumn("_best", best).filter(-F.col("table_no") == F.col("_best")["col2"]).drop("_lines", "_top", "_end", "_text", "_score", "_best")


def table_previews(tables: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, columns, header and the first three rows of every table."""
    sample = F.slice(F.sort_array(F.collect_list(F.when(F.col("row_no").between(1, 3), F.struct("row_no", _texts().alias("cells"))))), 1, 3)
    return tables.groupBy(*keys, "table_no").agg(F.count_if(F.col("row_no") > 0).alias("n_rows"), F.first("header").alias("header"), sample.alias("sample")).withColumn("n_columns", F.size("header"))


def key_values(tables: DataFrame, keys: list[str], names: dict[str, list[str]]) -> DataFrame:
    """Facts of two-column tables: for each output column the value beside the first key that contains one of its words."""
    pair = tables.filter(F.size("cells") == 2).select(*keys, "table_no", "row_no", F.lower(_texts()[0]).alias("k"), _texts()[1].alias("v"))
    order = F.struct("table_no", "row_no")
    has = lambda words: F.expr(" or ".join(f"contains(k, '{w}')" for w in words))
    return pair.groupBy(*keys).agg(*(F.min_by(F.when(has(w), F.col("v")), F.when(has(w), order)).alias(n) for n, w in names.items()))


# For each section the fields of its rows and the headers that hold them, in order of preference.
SECTION_FIELDS = {
    "Holdings": {"rank": ["rank", "#"], "participant_name": ["name of ccass participant", "participant", "name"], "participant_id": ["ccass id", "participant id", "id"], "shares": ["holding", "shares", "securities"], "stake": ["stake %", "holding percentage", "stake", "%"], "cumulative": ["cumul stake", "cumulative percentage", "cumulative %", "cumulative", "cum"]},
    "Changes": {"participant_name": ["participant", "name"], "change": ["change in shares", "change"], "change_pct": ["change %", "% change", "stake change"], "shares_after": ["holding after", "holding"], "stake_after": ["stake after", "stake"]},
    "Big Changes": {"date": ["date"], "participant_name": ["participant", "name"], "change_shares": ["change in shares", "shares", "holding change"], "change_pct": ["change %", "% change", "%"]},
    "Concentration": {"date": ["date"], "top5": ["top 5", "top5"], "top10_ncip": ["top 10 + ncip", "top 10 +ncip", "top 10 ncip", "ncip"], "top10": ["top 10 %", "top 10", "top10"], "stake": ["stake in ccass", "ccass", "stake"]},
    "Price History": {"date": ["date"], "close": ["close", "price"], "open": ["open"], "high": ["high"], "low": ["low"], "volume": ["volume", "vol"], "turnover": ["turnover", "value", "amount"], "vwap": ["vwap", "average price", "avg price"], "price_source": ["price_source", "price source"], "turnover_est": ["turnover_est", "turnover est"], "vwap_est": ["vwap_est", "vwap est"]},
}
#: Fields without whose columns a table isn't one of its section.
SECTION_NEEDS = {
    "Holdings": ["participant_name", "shares", "stake"], "Changes": ["participant_name", "change"], "Big Changes": ["date", "participant_name", "_change"],
    "Concentration": ["date", "top5", "top10"], "Price History": ["date", "close"],
}
#: Fields that are text; all others become numbers.
TEXT_FIELDS = {"participant_name", "participant_id", "date", "price_source"}


def _section_places(section: str) -> dict[str, Column]:
    """The place of each field's column by a table's header, as header_index() gives it.

    The NCIP column of a concentration table isn't taken for its Top 10 column. A column of changes in percent may be named by
    a delta; without one, the column of changes stands for it, in Big Changes if there is none of shares.
    """
    header = F.col("header")
    plain = F.transform("header", lambda h: F.when(~F.lower(h).contains("ncip"), h).otherwise(""))
    places = {f: header_index(plain if f == "top10" else header, names) for f, names in SECTION_FIELDS[section].items()}
    if section == "Changes":
        by_delta = F.transform("header", lambda h: h.contains("Δ") | scalars.normal_name(h).contains("delta"))
        places["change_pct"] = F.coalesce(F.nullif(F.array_position(by_delta, F.lit(True)), F.lit(0).cast("long")), places["change_pct"], places["change"])
    if section == "Big Changes":
        places["_change"] = F.coalesce(places["change_shares"], header_index(header, ["change"]))
        places["change_pct"] = F.coalesce(places["change_pct"], F.when(places["change_shares"].isNull(), places["_change"]))
    return places


def section_rows(tables: DataFrame, keys: list[str], section: str, chosen: dict[str, int] | None = None, place: Column | None = None) -> DataFrame:
    """Rows of a section's table with harmonised, cleaned columns; null where a page has no such column, no rows without those
    that the section needs.

    Holdings without a column of ranks are numbered by their places, blank dates of Big Changes take the date above; rows
    without a participant, a price's date or any value are left out after that. Dates become DATE.
    place: a row's number in the whole listing, by its keys and row_no, if the listing goes on over several pages.
    """
    fields, places = SECTION_FIELDS[section], _section_places(section)
    needed = reduce(lambda a, b: a & b, (places[f].isNotNull() for f in SECTION_NEEDS[section]))
    # found in the header row, once a table
    found = F.max(F.when((F.col("row_no") == 0) & needed, F.struct(*(places[f].alias(f"_{f}") for f in fields)))).over(Window.partitionBy(*keys, "table_no"))
    # no more goes through the shuffle by page than is read: the texts of the cells, and each table's header once
    narrow = tables.select(*keys, "table_no", "row_no", "is_header", F.when(F.col("row_no") == 0, F.col("header")).alias("header"), _texts().alias("texts"))
    body = _body(_of_section(narrow, keys, section, chosen, F.col("texts")).withColumn("_found", found)).filter("_found is not null").select(*keys, "row_no", "texts", "_found.*")
    at = {f: F.nullif(cell(F.col("texts"), F.col(f"_{f}")), F.lit("")) for f in fields}
    if section == "Holdings":
        body = body.withColumn("_place", F.when(F.col("_rank").isNull(), F.col("row_no") if place is None else place))
    if section == "Big Changes":
        above = Window.partitionBy(*keys).orderBy("row_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        body, at["date"] = body.withColumn("_above", F.last(at["date"], ignorenulls=True).over(above)), F.col("_above")
    if section == "Concentration":
        body = body.filter(F.coalesce(*at.values()).isNotNull())
    flags = [F.col("_vwap_est").isNotNull().alias("_has_vwap_est")] if section == "Price History" else []
    rows = body.select(*keys, "row_no", *flags, *((F.coalesce("_place", scalars.to_number(c)) if f == "rank" else c if f in TEXT_FIELDS else scalars.to_number(c)).alias(f) for f, c in at.items()))
    if "participant_name" in fields:
        rows = rows.filter(F.trim(F.coalesce("participant_name", F.lit(""))) != "")
    if section == "Price History":
        rows = _rounded_prices(rows.filter(F.trim(F.coalesce("date", F.lit(""))) != ""))
    return rows.withColumn("date", scalars.parse_date(F.col("date"))) if "date" in fields else rows


def _rounded_prices(rows: DataFrame) -> DataFrame:
    """Prices to three decimals, turnover to two; where the page has no column for it, vwap_est follows from the estimated
    turnover of the source that has no VWAP."""
    digits = {"close": 3, "open": 3, "high": 3, "low": 3, "vwap": 3, "vwap_est": 3, "turnover": 2, "turnover_est": 2}
    rounded = rows.withColumns({c: F.round(c, n) for c, n in digits.items()})
    unknown = (F.lower("price_source") == "yahoo") & F.col("vwap").isNull()
    estimate = F.when(unknown, F.round(F.try_divide("turnover_est", F.nullif("volume", F.lit(0.0))), 3))
    return rounded.withColumn("vwap_est", F.when(F.col("_has_vwap_est"), F.col("vwap_est")).otherwise(estimate)).drop("_has_vwap_est")
