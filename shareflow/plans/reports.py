"""Whole reports, put together from operators: each is a plan over all codes at once.

Reports that read the snapshots for several frames write them once first, with the columns they need; stored=True says
that they are a stored table already.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shareflow.functions.rules import with_category
from shareflow.functions.scalars import participant_id, participant_label, stock_code
from shareflow.operators import announcements as news
from shareflow.operators import capital, concentration, flows, history, prices, quality, snapshots
from shareflow.operators.tables import last_rows, limited, ordered_codes, recent, top_rows, within_bounds
from shareflow.sinks import export
from shareflow.sinks.once import once
from shareflow.sources import pages


class StockReport(NamedTuple):
    """Frames of the single-stock report, for all codes."""

    holdings: DataFrame
    changes: DataFrame
    concentration: DataFrame
    patterns: DataFrame
    moves: DataFrame
    big_changes: DataFrame
    warnings: DataFrame | None


class PriceReport(NamedTuple):
    """Frames of the price report, for all codes."""

    prices: DataFrame
    stats: DataFrame


class HistoryReport(NamedTuple):
    """Frames of the participants' history report, for all codes, aligned to the sampled dates."""

    history: DataFrame
    broker_counts: DataFrame
    concentration: DataFrame
    prices: DataFrame
    latest: DataFrame


SNAPSHOT = ["code", "date", "participant_id", "participant_name", "shares", "bps"]


def _kept(snaps: DataFrame, stored: bool) -> DataFrame:
    return snaps if stored else once(snaps.select(*SNAPSHOT), "report-snapshots")


def categories_of(snaps: DataFrame) -> DataFrame:
    """Category of each distinct participant (of several names the least)."""
    return with_category(snaps.groupBy("participant_id").agg(F.min("participant_name").alias("participant_name")))


def stock_report(snaps: DataFrame, holdings_limit: int | None = 15, changes_limit: int | None = 20, dates_limit: int | None = 15, big_limit: int | None = 10, log: DataFrame | None = None, price_history: DataFrame | None = None, stored: bool = False, changes: DataFrame | None = None, moves_limit: int | None = 5) -> StockReport:
    """Latest holdings and changes of each code with categories, its concentration on both bases, patterns, major moves,
    the largest changes of stakes of all dates, and (if the fetch log and prices are given) the warnings.

    A limit of None gives all rows. changes: the changes between consecutive dates, if they are a stored table already.
    """
    snaps = _kept(snaps, stored)
    kinds = categories_of(snaps).select("participant_id", "category")
    latest = snaps.groupBy("code").agg(F.max("date").alias("date"))
    ranked = snapshots.holdings_ranked(snaps.join(latest, ["code", "date"]))
    holdings = (ranked if holdings_limit is None else ranked.filter(F.col("rank") <= holdings_limit)).join(kinds, "participant_id", "left")
    changes = snapshots.consecutive_changes(snaps, snapshots.date_order(snaps)) if changes is None else changes
    moved = changes.join(latest, ["code", "date"])
    top = limited(moved, ["code"], [F.desc_nulls_last(F.abs("change_shares")), F.asc("participant_id")], changes_limit, "row_no").join(kinds, "participant_id", "left")
    series = limited(concentration_report(snaps), ["code"], [F.desc("date")], dates_limit, "row_no")
    big = limited(changes.filter("change_bps is not null"), ["code"], [F.desc(F.abs("change_bps")), F.desc("date"), F.asc("participant_id")], big_limit, "row_no").join(kinds, "participant_id", "left")
    warnings = quality_report(log, price_history) if log is not None and price_history is not None else None
    return StockReport(holdings, top, series, flows.change_patterns(moved), flows.major_moves(moved, moves_limit), big, warnings)


def screen(snaps: DataFrame, meta: DataFrame, codes: DataFrame, stored: bool = False) -> DataFrame:
    """One row per requested code (text column `code`, order `seq`): concentration, largest holder, biggest move, or an error."""
    snaps = _kept(snaps, stored)
    wanted = codes.select("seq", stock_code(F.col("code")).alias("code"), F.col("code").alias("requested"))
    kinds = categories_of(snaps).select("participant_id", "category")
    summary = snapshots.date_summary(snaps)
    latest = summary.select("code", F.col("latest_date").alias("date"))
    series = snapshots.concentration_series(snaps).join(latest, ["code", "date"])
    holder = flows.largest_participant(snapshots.holdings_ranked(snaps.join(latest, ["code", "date"]))).join(kinds, "participant_id", "left")
    holder = holder.select("code", F.col("participant_id").alias("largest_id"), F.col("participant_name").alias("largest_name"), F.col("category").alias("largest_category"), F.col("bps").alias("largest_bps"))
    move = flows.biggest_move(snapshots.consecutive_changes(snaps, snapshots.date_order(snaps)), "change_shares", ["date", "participant_id"]).select("code", F.col("participant_id").alias("mover_id"), F.col("change_shares").alias("mover_change"), F.col("date").alias("mover_date"))
    out = wanted.join(meta.select("code", "name"), "code", "left").join(series, "code", "left").join(holder, "code", "left").join(move, "code", "left").join(summary.select("code", "history_depth"), "code", "left")
    error = F.when(F.col("code") == "", "invalid stock code").when(F.col("date").isNull(), "no snapshot of this code")
    return out.withColumn("error", error)


def participant_search(snaps: DataFrame, wanted_id: str, codes: DataFrame) -> DataFrame:
    """One row per requested code: the latest holding of a participant, or found = false. All holdings are searched."""
    pid = participant_id(F.lit(wanted_id))
    latest = snaps.groupBy("code").agg(F.max("date").alias("date"))
    ranked = snapshots.holdings_ranked(snaps.join(latest, ["code", "date"])).filter(F.upper(F.trim("participant_id")) == pid)
    found = codes.select(stock_code(F.col("code")).alias("code")).distinct().join(ranked, "code", "left")
    return found.withColumn("found", F.col("participant_id").isNotNull())


def diff_report(snaps: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Changed participants, net flow by category, and a summary of each pair of dates."""
    compared = snapshots.diff(snaps, pairs)
    keys = ["code", "date_a", "date_b"]
    kinds = categories_of(snaps)
    return snapshots.changed_only(compared), snapshots.net_flow(compared, kinds, keys), snapshots.diff_summary(compared)


def price_report(price_history: DataFrame, share_changes: DataFrame, meta: DataFrame, limit: int = 20, days: int | None = None, start: str | None = None) -> PriceReport:
    """The latest prices of each code with market cap and turnover by cap, capital from share changes or the stock's data,
    and each code's statistics; of the last `days` of each code, or from `start` on, if given."""
    rows = recent(price_history, ["code"], "date", days)
    rows = rows.filter(F.col("date") >= F.lit(start).cast("date")) if start else rows
    return PriceReport(prices.with_share_capital(prices.latest_prices(rows, limit), capital.latest_capital(share_changes), meta), prices.price_stats(rows, meta))


def announcement_report(announcements: DataFrame, as_of: str, years: int = 1) -> tuple[DataFrame, DataFrame]:
    """The timeline of tagged announcements of a period and the tags of each code."""
    period = news.in_period(announcements, as_of, years)
    return news.timeline(period), news.tag_summary(period)


def capital_report(share_changes: DataFrame, buybacks: DataFrame, changes_limit: int | None = 30, buybacks_limit: int | None = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Latest capital of each code, its first share changes with tags, and its first buybacks; a limit of None gives all."""
    return capital.latest_capital(share_changes), capital.first_in_source_order(capital.tagged_changes(share_changes), changes_limit), capital.first_in_source_order(buybacks, buybacks_limit)


def participant_history(snaps: DataFrame, top: int = 10, most_dates: int = 12, stored: bool = False) -> DataFrame:
    """Stakes of today's largest participants on evenly sampled dates of the last year."""
    snaps = _kept(snaps, stored)
    ranked = snapshots.holdings_ranked(snaps)
    return history.dense_history(history.top_participants(ranked, top), history.sampled_dates(snaps, most_dates), snaps)


def history_report(snaps: DataFrame, price_history: DataFrame, top: int = 10, most_dates: int = 12, stored: bool = False) -> HistoryReport:
    """Stakes of the largest participants on sampled dates; broker counts and concentration of these dates; prices of the
    time they span; and the last line of each participant."""
    snaps = _kept(snaps, stored)
    dates = history.sampled_dates(snaps, most_dates)
    stakes = history.dense_history(history.top_participants(snapshots.holdings_ranked(snaps), top), dates, snaps)
    brokers = snapshots.broker_counts(snaps.join(dates, ["code", "date"], "left_semi"))
    series = concentration_report(snaps).join(dates, ["code", "date"], "left_semi")
    return HistoryReport(stakes, brokers, series, within_bounds(price_history, dates, ["code"], "date"), last_rows(stakes, ["code", "participant_id"], "date"))


def price_chart(price_history: DataFrame, days: int | None = 365) -> DataFrame:
    return prices.with_labels(prices.chart_frame(price_history, days))


def requested_codes(codes: DataFrame, limit: int = 20) -> DataFrame:
    """Distinct codes of a request in order; those beyond the limit are marked."""
    return ordered_codes(codes, stock_code(F.col("code")), "seq", limit)


def quality_report(log: DataFrame, price_history: DataFrame) -> DataFrame:
    """All warnings of a code, each once: failed sections, then notes on estimates."""
    notes = quality.estimate_notes(price_history).select("code", F.lit(2**40).alias("seq"), F.col("note").alias("warning"))
    return quality.distinct_warnings(quality.failure_warnings(log).unionByName(notes))


def concentration_report(snaps: DataFrame) -> DataFrame:
    """The concentration series as a feed on the registry's basis, with both bases and the stale flag."""
    return concentration.dual_basis(concentration_feed(snaps))


def concentration_feed(snaps: DataFrame) -> DataFrame:
    """Percentages of what the registry holds, and how much of the issued shares that is, from snapshots."""
    series = snapshots.concentration_series(snaps)
    return series.select("code", "date", F.col("top5_pct_of_ccass").alias("top5_pct"), F.col("top10_pct_of_ccass").alias("top10_pct"), F.lit(None).cast("double").alias("top10_ncip_pct"), (F.col("total_bps") / 10000.0).alias("stake_pct"))


def events_report(page_rows: DataFrame, site: str, limit: int = 30, page: str | None = None) -> DataFrame:
    """The first corporate events of each code's page (code, html), with the date up to which the page is known.

    page: the column that numbers the pages of a code, if its events stand on several. Pages are read once, into a table.
    """
    keys = ["code", page] if page else ["code"]
    rows = once(pages.corporate_events(page_rows, keys, site), "report-events")
    first = top_rows(rows, ["code"], [F.asc(c) for c in (*keys[1:], "row_no")], limit, "event_no")
    known = rows.groupBy("code").agg(F.max("announced").alias("data_as_of"), F.count(F.lit(1)).alias("total_rows"))
    return first.drop("row_no", *keys[1:]).join(known, "code")


def people_report(officer_pages: DataFrame, manager_pages: DataFrame, site: str, current_only: bool = True, page: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Officers (those in office, unless all are asked for) and managers of each code's pages.

    page: the column that numbers the pages of a code's officers, if there are several; it is in the result.
    """
    people = pages.officers(officer_pages, ["code", page] if page else ["code"], site)
    return people.filter("is_current") if current_only else people, pages.managers(manager_pages, ["code"])


def full_export(snaps: DataFrame, share_changes: DataFrame, buybacks: DataFrame, log: DataFrame, price_history: DataFrame, source: str, meta: DataFrame | None = None, more: dict[str, DataFrame] | None = None, holdings_limit: int | None = None, changes_limit: int | None = None) -> DataFrame:
    """All sections of all codes as one table with provenance: metadata and status rows first, warnings last.

    Sections are whole: all holdings and changes of the latest date (unless a limit is given), all changes of stakes, the
    patterns and all moves of the latest date, the concentration and prices of all dates, the latest capital, all share
    changes and buybacks, and the fetch log. Metadata has the facts of each code's report beside its own columns.
    more: sections read from pages (events, officers, managers), each with a code column.
    """
    snaps = _kept(snaps, False)
    moved = once(snapshots.consecutive_changes(snaps, snapshots.date_order(snaps)), "report-changes")
    report = stock_report(snaps, holdings_limit, changes_limit, None, None, stored=True, changes=moved, moves_limit=None)
    latest, changes, bought = capital_report(share_changes, buybacks, None, None)
    fetched = log.withColumnsRenamed({"section": "fetched_section", "status": "fetch_status"})
    sections = {
        "Holdings": report.holdings, "Changes": report.changes, "Big Changes": report.big_changes, "Concentration": report.concentration, "Patterns": report.patterns, "Moves": report.moves,
        "Price History": prices.latest_prices(price_history, None), "Share capital": latest, "Share changes": changes, "Buybacks": bought, "Fetch log": fetched, **(more or {}),
    }
    summary = quality.fetch_summary(log).withColumnRenamed("section", "fetched_section").withColumnRenamed("error", "error_message").withColumnRenamed("status", "fetch_status")
    facts = meta.join(report_metadata(snaps, price_history, meta, source, stored=True).drop("name", "source"), "code", "left") if meta is not None else None
    return export.combined(sections, source, warnings=quality_report(log, price_history), summary=summary, metadata=facts)


def report_metadata(snaps: DataFrame, price_history: DataFrame, meta: DataFrame, source: str, stored: bool = False) -> DataFrame:
    """One row per code with the facts of its report: dates, depth of history, totals, concentration, largest holder, latest price."""
    snaps = _kept(snaps, stored)
    summary = snapshots.date_summary(snaps)
    ranked = snapshots.holdings_ranked(snaps.join(summary.select("code", F.col("latest_date").alias("date")), ["code", "date"]))
    held = ranked.groupBy("code").agg(F.sum("shares").alias("total_in_registry"), F.sum(F.coalesce("bps", F.lit(0))).alias("total_bps"))
    at = snapshots.cumulative_at(ranked).select("code", F.col("cumulative_5_bps").alias("top5_cumulative_bps"), F.col("cumulative_10_bps").alias("top10_cumulative_bps"))
    holder = flows.largest_participant(ranked).select("code", participant_label(F.col("participant_name"), F.col("participant_id")).alias("largest_participant"))
    priced = prices.latest_prices(price_history, 1).select("code", F.col("date").alias("price_history_latest_date"), "price_source", F.col("close").alias("latest_price"), F.col("volume").alias("latest_price_volume"), F.col("turnover").alias("latest_price_turnover"), F.col("vwap").alias("latest_price_vwap"))
    out = summary.select(
        "code",
        F.lit(source).alias("source"),
        F.col("latest_date").alias("holdings_data_date"),
        F.when(F.col("previous_date").isNotNull(), F.concat_ws(" to ", F.col("previous_date").cast("string"), F.col("latest_date").cast("string"))).alias("changes_date_range"),
        F.col("history_depth").alias("history_depth_days"),
    )
    for more in (meta.select("code", "name", F.col("issued_shares").alias("issued_securities")), held, at, holder, priced):
        out = out.join(more, "code", "left")
    return out.withColumn("outside_registry", F.col("issued_securities") - F.col("total_in_registry"))
