"""Histories of the largest participants: who they are now, sampled dates, a dense grid of both."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shareflow.functions.scalars import participant_label
from shareflow.operators.tables import recent


def top_participants(ranked: DataFrame, limit: int = 10) -> DataFrame:
    """Of the first `limit` rows of each code's latest holdings those with an id, numbered anew from 1, with a label."""
    latest = ranked.join(ranked.groupBy("code").agg(F.max("date").alias("date")), ["code", "date"])
    kept = latest.filter((F.col("rank") <= limit) & (F.trim("participant_id") != ""))
    number = F.row_number().over(Window.partitionBy("code").orderBy("rank"))
    return kept.select("code", "participant_id", "participant_name", participant_label(F.col("participant_name"), F.col("participant_id")).alias("label"), number.alias("order"))


def sampled_dates(dates: DataFrame, most: int = 12, days: int = 365) -> DataFrame:
    """At most `most` of each code's dates of the last year, evenly spread: positions round(i (n-1)/(most-1)), half to even."""
    kept = recent(dates.select("code", "date").filter("date is not null").distinct(), ["code"], "date", days)
    series = Window.partitionBy("code")
    numbered = kept.withColumns({"at": F.row_number().over(series.orderBy("date")) - 1, "n": F.count(F.lit(1)).over(series)})
    places = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (F.col("n") - 1) / F.lit(float(max(most - 1, 1))), 0).cast("int"))
    return numbered.filter((F.col("n") <= most) | F.array_contains(places, F.col("at"))).select("code", "date")


def dense_history(participants: DataFrame, dates: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Every participant on every sampled date of its code; who isn't listed on a date has a stake of 0 and no shares."""
    grid = participants.join(dates, "code")
    held = snapshots.select("code", "date", "participant_id", "shares", "bps")
    return grid.join(held, ["code", "date", "participant_id"], "left").select("code", "date", "order", "participant_id", "label", "shares", F.coalesce("bps", F.lit(0)).alias("bps"))
