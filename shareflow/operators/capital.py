"""Share capital changes and buybacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shareflow.functions.rules import reason_tags
from shareflow.operators.tables import first_rows, limited


def tagged_changes(changes: DataFrame) -> DataFrame:
    """Add the whole number of shares (the source gives millions) and the tags of the reason."""
    return changes.withColumns({"shares_approx": (F.col("shares_million") * 1_000_000).cast("bigint"), "reason_tags": reason_tags(F.col("reason"))})


def latest_capital(changes: DataFrame) -> DataFrame:
    """The record of the latest change date of each code, of those with a date and a number of shares."""
    known = tagged_changes(changes.filter("change_date is not null and shares_million is not null"))
    latest = first_rows(known, ["code"], [F.desc("change_date"), F.asc("seq")])
    return latest.select("code", "shares_million", F.col("shares_approx").alias("shares"), F.col("change_date").alias("as_of"), "reason")


def first_in_source_order(rows: DataFrame, limit: int | None) -> DataFrame:
    """The first rows of each code in the order of the source; all rows for None."""
    return limited(rows, ["code"], [F.asc("seq")], limit, "row_no")
