"""Column harmonising: which of a table's columns holds what, by parts of their names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shareflow.functions.scalars import normal_name


def normal(name: str) -> str:
    return re.sub(r"[^a-z0-9%+]+", " ", (name or "").lower()).strip()


def pick(columns: list[str], candidates: list[str]) -> str | None:
    """The first column, for the first candidate that any column's normal name contains."""
    return next((c for want in candidates if normal(want) for c in columns if normal(want) in normal(c)), None)


def place(header: list[str], candidates: list[str], without: str = "") -> int | None:
    """header_index() of a list; columns whose header holds the text `without` don't count, if one is given."""
    names = [None if h is None else "" if without and without in h else h for h in header]
    plain = [None if h is None else normal(h) for h in names]
    for want in candidates:
        sought = normal(want)
        for k, (name, text) in enumerate(zip(plain, names, strict=True)):
            if name is not None and (sought in name if sought else text.strip(" ") == want):
                return k + 1
    return None


def harmonised(df: DataFrame, wanted: dict[str, list[str]], required: list[str] = ()) -> DataFrame:
    """Select the wanted columns under their new names; those without a match are null, or an error if required."""
    found = {name: pick(df.columns, candidates) for name, candidates in wanted.items()}
    if missing := [name for name in required if not found[name]]:
        raise ValueError(f"no column for {', '.join(missing)} among {', '.join(df.columns)}")
    return df.select(*((F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(name) for name, c in found.items()))


def header_index(header: Column, candidates: list[str]) -> Column:
    """The place from 1 of the column that a header (array of texts) has for the candidates in order; null without one."""
    names = F.transform(header, normal_name)
    # a candidate of signs alone has no normal name: the header must be just that
    hits = lambda want: F.transform(names, lambda n: n.contains(normal(want))) if normal(want) else F.transform(header, lambda h: F.trim(h) == want)
    return F.coalesce(*(F.nullif(F.array_position(hits(want), F.lit(True)), F.lit(0).cast("long")) for want in candidates))


def cell(cells: Column, index: Column) -> Column:
    """The cell at a place from 1; null beyond the row or for a null place."""
    return F.when(index.isNotNull(), F.try_element_at(cells, index.cast("int")))
