"""Company announcements: tags, periods, timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shareflow.functions.rules import event_tags
from shareflow.functions.scalars import better_text, clean_extracted
from shareflow.operators.tables import first_rows


def tagged(announcements: DataFrame) -> DataFrame:
    return announcements.withColumn("event_tags", event_tags(F.col("category"), F.col("title")))


def in_period(announcements: DataFrame, as_of: str, years: int = 1) -> DataFrame:
    """Published in the last `years` (at least one) times 365 days before as_of."""
    return announcements.filter(F.col("publish_date") >= F.date_sub(F.lit(as_of).cast("date"), 365 * max(1, years)))


def timeline(announcements: DataFrame) -> DataFrame:
    """Announcements with a tag; whoever shows them sorts them by publish_date and news_id."""
    # the tags pass a lambda, which a filter on them would run a second time: explode them once instead
    rows = tagged(announcements).withColumn("event_tags", F.explode(F.array("event_tags")))
    return rows.filter(F.size("event_tags") > 0)


def tag_summary(announcements: DataFrame) -> DataFrame:
    """Per code: announcements, how many have a tag, and all tags in use."""
    return tagged(announcements).groupBy("code").agg(
        F.count(F.lit(1)).alias("announcements"), F.count_if(F.size("event_tags") > 0).alias("tagged"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("event_tags")))), ",").alias("tags")
    )


def best_texts(candidates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of several extracted texts of one document the best by text_quality(), of equals the first in `order`; blank texts don't count."""
    rows = candidates.withColumn("text", clean_extracted(F.col("text"))).filter("text <> ''")
    return first_rows(rows, keys, [better_text(F.col("text")).asc(), F.col(order).asc()])
