"""Tables derived from stored snapshots, kept up to date for the dates that a batch has touched.

The changes of a date depend on its own snapshot and the one before, the concentration on its own alone. So a batch that
touches (code, date) makes these changes stale: that date's, and those of the code's next date, which a late snapshot
gives a new predecessor. Snapshots are never taken out, so no derived row goes without another in its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shareflow.operators import snapshots
from shareflow.sinks.ingest import replace, written_beside

SERIES = ["code", "date"]


def stale_dates(stored: DataFrame, touched: DataFrame) -> DataFrame:
    """code, date and previous_date of touched dates and of the next date of each, among the dates of stored snapshots; was_touched tells them apart."""
    marks = touched.select(*SERIES).distinct().withColumn("was_touched", F.lit(True))
    dates = stored.join(marks.select("code").distinct(), "code", "left_semi").select(*SERIES).distinct().join(marks, SERIES, "left")
    before = Window.partitionBy("code").orderBy("date")
    known = dates.withColumns({"previous_date": F.lag("date").over(before), "after_touched": F.lag("was_touched").over(before)})
    return known.filter("was_touched or after_touched").select(*SERIES, "previous_date", F.coalesce("was_touched", F.lit(False)).alias("was_touched"))


def refresh(target: str, derived: str, touched: DataFrame) -> None:
    """Work out again what touched (code, date) rows of the snapshots at target make stale in derived/changes and derived/concentration.

    Only the affected dates and the ones before them are read; running it twice changes nothing.
    """
    stored = touched.sparkSession.read.parquet(target)
    stale = written_beside(stale_dates(stored, touched), f"{derived}/stale")
    pairs = stale.filter("previous_date is not null").select("code", F.col("previous_date").alias("date_a"), F.col("date").alias("date_b"))
    moved = snapshots.diff(stored, pairs).select("code", F.col("date_b").alias("date"), "participant_id", "participant_name", "change_shares", "change_bps", F.col("shares_b").alias("shares_after"), F.col("bps_b").alias("bps_after"))
    replace(f"{derived}/changes", moved, stale.select(*SERIES), SERIES)
    own = stale.filter("was_touched").select(*SERIES)
    replace(f"{derived}/concentration", snapshots.concentration_series(snapshots.snapshots_at(stored, own)), own, SERIES)
