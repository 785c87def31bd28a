"""Data quality: fetch logs into warnings and structured errors, cross-section checks, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shareflow.functions.rules import HISTORY_GAP, contains_any, error_code, retryable
from shareflow.functions.scalars import blank_to_null
from shareflow.operators.tables import first_rows

SECTIONS = ["Holdings", "Changes", "Big Changes", "Concentration", "Price History"]


def failed() -> Column:
    """A fetch failed: its status says so or it has an error."""
    return F.lower(F.coalesce("status", F.lit(""))).isin("failed", "false") | (F.coalesce("error_message", F.lit("")) != "")


def history_gap() -> Column:
    """A Big Changes failure that only means too few days of history."""
    return (F.lower(F.trim("section")) == "big changes") & contains_any(F.lower(F.coalesce("error_message", F.lit(""))), HISTORY_GAP)


def failure_warnings(log: DataFrame) -> DataFrame:
    """code, seq, warning of each failed fetch."""
    gap = "Big Changes unavailable: too few days of history, so the timing of large moves is not known."
    text = F.concat(F.col("section"), F.lit(" failed or incomplete: "), F.coalesce(blank_to_null(F.col("error_message")), F.lower("status")))
    return log.filter(failed()).select("code", "seq", F.when(history_gap(), gap).otherwise(text).alias("warning"))


def structured_errors(log: DataFrame, error_type: str | None = None) -> DataFrame:
    """code, seq, error_code, message, retry of each failed fetch but history gaps."""
    kind = F.col(error_type) if error_type else F.lit("")
    bad = log.filter(failed() & ~history_gap()).withColumn("error_code", error_code(kind, F.col("error_message")))
    message = F.concat(F.col("section"), F.lit(": "), F.coalesce(blank_to_null(F.col("error_message")), F.lower("status")))
    return bad.select("code", "seq", "error_code", message.alias("message"), retryable(F.col("error_code")).alias("retry"))


def errors_from_warnings(warnings: DataFrame) -> DataFrame:
    """Structured errors of free-text warnings; notes on data quality aren't errors."""
    text = F.lower("warning")
    code = F.when(contains_any(text, ["issue lookup failed", "issue id"]), "ISSUE_LOOKUP_FAILED").when(contains_any(text, ["budget exhausted", "cold"]), "COLD_START").when(text.contains("timeout"), "SOURCE_TIMEOUT")
    return warnings.select("code", "seq", code.alias("error_code"), F.col("warning").alias("message")).filter("error_code is not null").withColumn("retry", retryable(F.col("error_code")))


def distinct_errors(errors: DataFrame) -> DataFrame:
    """The first of equal (error_code, message) of a code."""
    return first_rows(errors, ["code", "error_code", "message"], [F.asc("seq")])


def distinct_warnings(warnings: DataFrame) -> DataFrame:
    """Each warning of a code once, at its first place."""
    return first_rows(warnings, ["code", "warning"], [F.asc("seq")])


def primary_failure(log: DataFrame) -> DataFrame:
    """The first failed fetch of each code."""
    return first_rows(log.filter(failed()), ["code"], [F.asc("seq")]).select("code", "seq", "section", "status", "error_message")


def payload_status(log: DataFrame) -> DataFrame:
    """Per code: ok, and if not the first error's code and message."""
    errors = first_rows(structured_errors(log), ["code"], [F.asc("seq")]).select("code", "error_code", F.col("message").alias("hint"))
    return log.select("code").distinct().join(errors, "code", "left").withColumn("ok", F.col("error_code").isNull())


def fetch_summary(log: DataFrame) -> DataFrame:
    """A row per code and section: the last status, tables found, latest date and error; sections never fetched are `missing`."""
    grid = log.select("code").distinct().select("code", F.posexplode(F.array(*map(F.lit, SECTIONS))).alias("section_no", "section"))
    last = first_rows(log, ["code", "section"], [F.desc("seq")]).select("code", "section", "status", "tables_found", "error_message")
    dates = log.groupBy("code", "section").agg(F.max("fetched_on").alias("latest_date"))
    out = grid.join(last, ["code", "section"], "left").join(dates, ["code", "section"], "left")
    return out.select("code", "section_no", "section", F.coalesce("status", F.lit("missing")).alias("status"), F.coalesce("tables_found", F.lit(0)).alias("tables_found"), "latest_date", blank_to_null(F.col("error_message")).alias("error"))


def run_totals(log: DataFrame) -> DataFrame:
    """Per day: fetches, and how many went well and failed."""
    return log.groupBy("fetched_on").agg(F.count(F.lit(1)).alias("total"), F.count_if(~failed()).alias("ok"), F.count_if(failed()).alias("failed"))


def fetched_days(log: DataFrame) -> DataFrame:
    """Per code: on how many days it was fetched, and the last of them."""
    return log.groupBy("code").agg(F.count_distinct("fetched_on").alias("fetched_days"), F.max("fetched_on").alias("data_as_of"))


def cross_section_warnings(present: DataFrame) -> DataFrame:
    """Warnings of codes (flags holdings, changes, big_changes, concentration) of which one section needs another."""
    texts = F.array_compact(
        F.array(
            F.when(F.expr("concentration and not holdings"), "Concentration is there, but Holdings failed: broker-level analysis is incomplete."),
            F.when(F.expr("big_changes and not changes"), "Big Changes are there, but daily Changes failed: recent movement can't be confirmed."),
        )
    )
    return present.select("code", F.explode(texts).alias("warning"))


def estimate_notes(prices: DataFrame) -> DataFrame:
    """Notes on codes whose prices come from a source that gives no turnover."""
    flags = prices.groupBy("code").agg(F.bool_or(F.col("price_source") == "yahoo").alias("estimated"), F.bool_or((F.col("price_source") == "yahoo") & F.col("vwap").isNull()).alias("vwap_estimated"))
    notes = F.array_compact(F.array(F.when(F.col("estimated"), "Turnover is volume times close, an estimate"), F.when(F.col("vwap_estimated"), "VWAP follows from estimated turnover")))
    return flags.select("code", F.explode(notes).alias("note"))


def limited_history(summary: DataFrame) -> DataFrame:
    """Codes with one snapshot date or none, whose changes can't be computed."""
    return summary.filter("history_depth <= 1").select("code", "history_depth")


def with_provenance(df: DataFrame, data_as_of: Column, source: str) -> DataFrame:
    """Fill data_as_of and source where they are blank."""
    have = lambda c: F.col(c) if c in df.columns else F.lit(None)
    return df.withColumns({"data_as_of": F.coalesce(have("data_as_of").cast("date"), data_as_of), "source": F.coalesce(blank_to_null(have("source").cast("string")), F.lit(source))})


def fresh_codes(prices: DataFrame, as_of: str, column: str = "date") -> DataFrame:
    """Codes that have a row of the given day."""
    return prices.filter(F.to_date(F.col(column)) == F.lit(as_of).cast("date")).select("code").distinct()
