"""Holdings snapshots: one row per (code, date, participant_id) with shares and bps, ten-thousandths of a percent of the
issued shares. All operators work on all codes and dates at once; ties in shares go to the smaller participant_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shareflow.functions.scalars import is_participant_id
from shareflow.operators.tables import spread, top_rows

SERIES = ["code", "date"]


def _by_shares() -> list[Column]:
    return [F.desc("shares"), F.asc("participant_id")]


def snapshots_at(snapshots: DataFrame, wanted: DataFrame) -> DataFrame:
    """The snapshots of the wanted (code, date) pairs."""
    return snapshots.join(wanted.select("code", "date").distinct(), ["code", "date"], "left_semi")


def snapshot_at(snapshots: DataFrame, code: str, date: str) -> DataFrame:
    """One snapshot, largest holdings first; both conditions reach the scan."""
    return snapshots.filter((F.col("code") == code) & (F.col("date") == F.lit(date).cast("date"))).orderBy(*_by_shares())


def holdings_ranked(snapshots: DataFrame) -> DataFrame:
    """Rank by shares, and bps accumulated in that order (a missing stake adds nothing)."""
    order = Window.partitionBy(*SERIES).orderBy(*_by_shares())
    so_far = F.sum(F.coalesce("bps", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return snapshots.select(*SERIES, F.row_number().over(order).alias("rank"), "participant_id", "participant_name", "shares", "bps", so_far.alias("cumulative_bps"))


def cumulative_at(ranked: DataFrame) -> DataFrame:
    """Cumulative bps at ranks 5 and 10; null where a snapshot has fewer rows."""
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("cumulative_bps"))).alias(f"cumulative_{k}_bps")
    return ranked.groupBy(*SERIES).agg(at(5), at(10))


def date_pairs(snapshots: DataFrame) -> DataFrame:
    """Each snapshot date of a code with the one before it."""
    dates = snapshots.select(*SERIES).distinct()
    return dates.withColumn("previous_date", F.lag("date").over(Window.partitionBy("code").orderBy("date")))


def date_summary(snapshots: DataFrame) -> DataFrame:
    """Latest date, the date before it and the number of distinct dates of each code."""
    pairs = date_pairs(snapshots)
    return pairs.groupBy("code").agg(F.max("date").alias("latest_date"), F.max_by("previous_date", "date").alias("previous_date"), F.count(F.lit(1)).alias("history_depth"))


def concentration_series(snapshots: DataFrame) -> DataFrame:
    """Per snapshot: bps of the 5 and 10 largest holdings, of all, and their share of the total.

    Ranks are by shares; a holding without a stake keeps its place and adds nothing. of_ccass columns are null if the
    total is zero.
    """
    ranked = snapshots.select(*SERIES, "bps", F.row_number().over(Window.partitionBy(*SERIES).orderBy(*_by_shares())).alias("rank"))
    stake = F.coalesce("bps", F.lit(0))
    sums = ranked.groupBy(*SERIES).agg(
        F.sum(F.when(F.col("rank") <= 5, stake).otherwise(0)).alias("top5_bps"),
        F.sum(F.when(F.col("rank") <= 10, stake).otherwise(0)).alias("top10_bps"),
        F.sum(stake).alias("total_bps"),
    )
    share = lambda c: F.try_divide(F.col(c) * 100.0, F.col("total_bps"))
    return sums.withColumns({"top5_pct_of_ccass": share("top5_bps"), "top10_pct_of_ccass": share("top10_bps")})


def top_stakes(snapshots: DataFrame, k: int = 5) -> DataFrame:
    """Sum of the k greatest stakes of each snapshot, whatever their rank by shares; null if no stake is known."""
    ranked = top_rows(snapshots.filter("bps is not null"), SERIES, [F.desc("bps"), F.asc("participant_id")], k)
    return snapshots.select(*SERIES).distinct().join(ranked.groupBy(*SERIES).agg(F.sum("bps").alias("top_bps")), SERIES, "left")


def broker_counts(snapshots: DataFrame) -> DataFrame:
    """Participants with a valid id on each date."""
    return snapshots.filter(is_participant_id(F.col("participant_id"))).groupBy(*SERIES).agg(F.count(F.lit(1)).alias("participants"))


def snapshot_totals(snapshots: DataFrame) -> DataFrame:
    """Total shares and bps of each snapshot, and the change in shares since the one before."""
    totals = snapshots.groupBy(*SERIES).agg(F.sum("shares").alias("total_shares"), F.sum(F.coalesce("bps", F.lit(0))).alias("total_bps"))
    return totals.withColumn("change_shares", F.col("total_shares") - F.lag("total_shares").over(Window.partitionBy("code").orderBy("date")))


def _own(column: str, side: str) -> Column:
    """A column's value on one side of a comparison; a participant has one row a side."""
    return F.max(F.when(F.col("side") == side, F.col(column)))


def date_order(snapshots: DataFrame) -> DataFrame:
    """The dates of each code with the first and the next one; only distinct dates are ever sorted."""
    order = Window.partitionBy("code").orderBy("date")
    first = F.min("date").over(Window.partitionBy("code"))
    return snapshots.select(*SERIES).distinct().withColumns({"next_date": F.lead("date").over(order), "first_date": first})


def consecutive_changes(snapshots: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Per code and date with a date before it: each participant's change in shares and bps.

    Participants of either date appear; bps changes only where both stakes are known, a participant that left holds 0.

    A sweep over signed events, in one read: each row counts for its own date and, with the opposite sign, for the code's
    next date; one sum by (code, date, participant) gives the changes. The next date comes from a window by code, and the
    sum stays in its partitions: all rows of a code are sorted in one task. Where codes are few and long, give the
    date_order() of the snapshots: then they are read a second time for it, no task has more than a date of a code or a part
    of all (code, date, participant), and the events are dealt once, to tasks whose number grows with what is set: they are
    sorted for the sum there alone.
    """
    later = Window.partitionBy("code").orderBy(F.unix_date("date").desc()).rangeBetween(Window.unboundedPreceding, -1)
    rows = snapshots.select("code", "date", "participant_id", "participant_name", "shares", "bps")
    if dates is None:
        dated = rows.withColumns({"next_date": F.min("date").over(later), "first_date": F.min("date").over(Window.partitionBy("code"))})
    else:
        ordered = dates.withColumnsRenamed({"code": "_code", "date": "_date"})
        dated = rows.join(ordered, F.col("code").eqNullSafe(F.col("_code")) & (F.col("date") == F.col("_date")))
    own = F.when(F.col("date") > F.col("first_date"), F.struct("date", F.lit("after").alias("side")))
    following = F.when(F.col("next_date").isNotNull(), F.struct(F.col("next_date").alias("date"), F.lit("before").alias("side")))
    events = dated.select("code", "participant_id", "participant_name", "shares", "bps", F.explode(F.array_compact(F.array(own, following))).alias("event"))
    events = events.select("code", "event.date", "event.side", "participant_id", "participant_name", "shares", "bps")
    if dates is not None:
        events = spread(events, *SERIES, "participant_id")
    after = F.coalesce(_own("shares", "after"), F.lit(0))
    return events.groupBy(*SERIES, "participant_id").agg(
        F.coalesce(_own("participant_name", "after"), _own("participant_name", "before")).alias("participant_name"),
        (after - F.coalesce(_own("shares", "before"), F.lit(0))).alias("change_shares"),
        (_own("bps", "after") - _own("bps", "before")).alias("change_bps"),
        after.alias("shares_after"),
        _own("bps", "after").alias("bps_after"),
    )


def diff(snapshots: DataFrame, pairs: DataFrame) -> DataFrame:
    """Two-date comparison for each (code, date_a, date_b) of pairs: holdings, changes and status of every participant.

    Snapshots are read once: rows meet the pairs that their date is an end of, and a sum by pair and participant tells the
    sides apart.
    """
    end = lambda side: F.struct(F.col(f"date_{side}").alias("date"), F.lit(side).alias("side"))
    ends = pairs.select("code", "date_a", "date_b", F.explode(F.array(end("a"), end("b"))).alias("end")).select("code", "date_a", "date_b", "end.date", "end.side")
    grouped = snapshots.join(ends.distinct(), SERIES).groupBy("code", "date_a", "date_b", "participant_id")
    both = grouped.agg(F.coalesce(_own("participant_name", "b"), _own("participant_name", "a")).alias("participant_name"), *(_own(c, side).alias(f"{c}_{side}") for c in ("shares", "bps") for side in "ab"))
    change = F.coalesce("shares_b", F.lit(0)) - F.coalesce("shares_a", F.lit(0))
    status = F.when(F.col("shares_a").isNull(), "new").when(F.col("shares_b").isNull(), "exited").when(change > 0, "increased").when(change < 0, "decreased").otherwise("unchanged")
    return both.select(
        "code",
        "date_a",
        "date_b",
        "participant_id",
        "participant_name",
        F.coalesce("shares_a", F.lit(0)).alias("shares_a"),
        F.coalesce("shares_b", F.lit(0)).alias("shares_b"),
        change.alias("change_shares"),
        "bps_a",
        "bps_b",
        (F.col("bps_b") - F.col("bps_a")).alias("change_bps"),
        status.alias("status"),
    )


def changed_only(changes: DataFrame) -> DataFrame:
    return changes.filter("change_shares <> 0")


def net_flow(changes: DataFrame, categories: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of changes by participant category, participants without change included."""
    known = changes.join(categories.select("participant_id", "category"), "participant_id", "left")
    return known.groupBy(*keys, F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.sum("change_shares").alias("net_change_shares"), F.count(F.lit(1)).alias("participants"))


def diff_summary(diffs: DataFrame) -> DataFrame:
    """Per pair: participants on each date, how many joined and left, top-5 stakes on each date."""
    keys = ["code", "date_a", "date_b"]
    top = lambda side: F.sum(F.when(F.col(f"rank_{side}") <= 5, F.col(f"bps_{side}"))).alias(f"top5_bps_{side}")
    rank = lambda side: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(f"bps_{side}"), "participant_id"))
    counted = lambda condition, name: F.count_if(F.expr(condition)).alias(name)
    return (
        diffs.withColumns({"rank_a": rank("a"), "rank_b": rank("b")})
        .groupBy(*keys)
        .agg(counted("status <> 'new'", "participants_a"), counted("status <> 'exited'", "participants_b"), counted("status = 'new'", "n_new"), counted("status = 'exited'", "n_exited"), top("a"), top("b"))
    )


def invalid_pairs(pairs: DataFrame) -> DataFrame:
    """Requests for a comparison that can't be made, with the reason: text columns code, date_a, date_b."""
    a, b = F.try_to_date("date_a", "yyyy-MM-dd"), F.try_to_date("date_b", "yyyy-MM-dd")
    error = F.when(F.trim("code") == "", "no stock code").when(a.isNull() | b.isNull(), "dates must be YYYY-MM-DD").when(a >= b, "date_a must be before date_b")
    return pairs.withColumn("error", error).filter("error is not null")
