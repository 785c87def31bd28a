"""Exports of a report's sections: one combined table, JSON by section, CSV by table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Leading columns of a combined table: what a row is, whose it is, where it comes from, and how its fetch went.
PROVENANCE = [
    "record_type", "section", "row_meaning", "code", "name", "issue_id", "source", "source_url", "fetched_at", "data_as_of",
    "status", "fetch_method", "http_status", "error_type", "error_message", "fallback_method",
]


def section_rows(section: str, rows: DataFrame, source: str, status: str = "success", record_type: str = "data", meaning: str | None = None) -> DataFrame:
    """Rows of a section with the leading columns in front, taken from the rows where they have them; all others become text.

    data_as_of is the rows' own, else their date.
    """
    given = {"record_type": record_type, "section": section, "row_meaning": meaning, "source": source, "status": status}
    have = lambda c: F.col(f"`{c}`").cast("string") if c in rows.columns else F.lit(given.get(c)).cast("string")
    lead: dict[str, Column] = {c: F.lit(given[c]).cast("string") if c in given else have(c) for c in PROVENANCE}
    if "data_as_of" not in rows.columns and "date" in rows.columns:
        lead["data_as_of"] = F.col("date").cast("string")
    rest = [F.to_json(c).alias(c) if kind.startswith(("array", "map", "struct")) else F.col(f"`{c}`").cast("string").alias(c) for c, kind in rows.dtypes if c not in PROVENANCE]
    return rows.select(*(x.alias(n) for n, x in lead.items()), *rest)


def combined(sections: dict[str, DataFrame], source: str, warnings: DataFrame | None = None, summary: DataFrame | None = None, metadata: DataFrame | None = None, meanings: dict[str, str] | None = None) -> DataFrame:
    """All sections as one table: a metadata row per code, status, data and warning rows; columns that a section lacks are null."""
    extra = [("Metadata", metadata, "metadata"), ("status", summary, "status")]
    frames = [section_rows(name, rows, source, record_type=kind) for name, rows, kind in extra if rows is not None]
    frames += [section_rows(name, rows, source, meaning=(meanings or {}).get(name)) for name, rows in sections.items()]
    frames += [section_rows("warnings", warnings, source, record_type="warning")] if warnings is not None else []
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_csv(df: DataFrame, path: str) -> None:
    """UTF-8 CSV with a header, quotes doubled inside quoted texts; arrays and structs as JSON."""
    flat = df.select(*(F.to_json(c).alias(c) if kind.startswith(("array", "map", "struct")) else F.col(f"`{c}`") for c, kind in df.dtypes))
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def json_records(sections: dict[str, DataFrame], metadata: DataFrame | None = None) -> DataFrame:
    """section, code and the record as JSON text (NaN and infinities become null) of every row; metadata, a row per code, as a section of that name."""
    sections = ({"metadata": metadata} if metadata is not None else {}) | sections

    def safe(df: DataFrame) -> list[Column]:
        return [F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c) if kind in ("double", "float") else F.col(f"`{c}`") for c, kind in df.dtypes]

    frames = [df.select(F.lit(name).alias("section"), (F.col("code") if "code" in df.columns else F.lit(None).cast("string")).alias("code"), F.to_json(F.struct(*safe(df))).alias("record")) for name, df in sections.items()]
    return reduce(DataFrame.unionByName, frames)


def write_json(sections: dict[str, DataFrame], path: str, metadata: DataFrame | None = None) -> None:
    """One folder of JSON records per section."""
    json_records(sections, metadata).select("section", "record").write.mode("overwrite").partitionBy("section").text(path)
