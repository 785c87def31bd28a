"""Concentration feeds: per code and date the stakes of the largest holders, in percent.

A feed has top5_pct, top10_pct, top10_ncip_pct (with shares outside the registry's investor accounts) and stake_pct (what
the registry holds of the issued shares); the first three are percentages of what the registry holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shareflow.operators.tables import recent

VALUES = ["top5_pct", "top10_pct", "top10_ncip_pct", "stake_pct"]


def dual_basis(feed: DataFrame) -> DataFrame:
    """Add the same figures as percentages of the issued shares, and whether that base seems out of date (over 100)."""
    issued = {f"{c}_of_issued": F.col(c) * F.col("stake_pct") / 100 for c in ("top5_pct", "top10_pct")}
    over = lambda c: F.coalesce(F.col(c) > 100, F.lit(False))
    return feed.withColumns(issued).withColumn("issued_may_be_stale", over("stake_pct") | over("top5_pct_of_issued") | over("top10_pct_of_issued"))


def five_observation_change(feed: DataFrame) -> DataFrame:
    """Latest values minus those of the fifth latest date (or the oldest of fewer), with both dates; needs two dates."""
    back = Window.partitionBy("code").orderBy(F.desc("date"))
    ranked = feed.filter("date is not null").withColumns({"_rank": F.row_number().over(back), "_n": F.count(F.lit(1)).over(Window.partitionBy("code"))}).filter("_rank <= 5 and _n >= 2")
    at = lambda c, condition: F.max(F.when(F.expr(condition), F.col(c)))
    base = "_rank = least(5, _n)"
    changes = [(at(c, "_rank = 1") - at(c, base)).alias(f"{c}_change") for c in ("top5_pct", "top10_pct", "stake_pct")]
    return ranked.groupBy("code").agg(at("date", base).alias("from_date"), at("date", "_rank = 1").alias("to_date"), *changes)


def bands(feed: DataFrame) -> DataFrame:
    """Rows per band of a stacked chart: Top 5, Top 6-10, NCIP, Other CCASS, Outside CCASS; only positive ones."""
    ncip = F.coalesce("top10_ncip_pct", "top10_pct")
    stake = F.coalesce("stake_pct", F.greatest(ncip, F.col("top10_pct")))
    parts = [("Top 5", F.col("top5_pct")), ("Top 6-10", F.col("top10_pct") - F.col("top5_pct")), ("NCIP", ncip - F.col("top10_pct")), ("Other CCASS", stake - ncip), ("Outside CCASS", 100 - stake)]
    rows = F.array(*(F.struct(F.lit(name).alias("band"), F.lit(k).alias("band_order"), pct.alias("percent")) for k, (name, pct) in enumerate(parts, 1)))
    known = feed.filter("date is not null and top5_pct is not null and top10_pct is not null")
    return known.select("code", "date", F.explode(rows).alias("b")).select("code", "date", "b.*").filter("percent > 0")


def lines(feed: DataFrame, days: int | None = 365) -> DataFrame:
    """Rows per line of a chart: top 5 and top 10 with NCIP; values outside 0 to 100.5 are left out."""
    ncip = F.when(F.col("top10_pct").isNotNull() & F.col("top10_ncip_pct").isNotNull(), F.greatest(F.col("top10_ncip_pct") - F.col("top10_pct"), F.lit(0.0)))
    rows = F.array(F.struct(F.lit("top5_ncip").alias("metric"), (F.col("top5_pct") + ncip).alias("percent")), F.struct(F.lit("top10_ncip").alias("metric"), F.col("top10_ncip_pct").alias("percent")))
    long = feed.filter("date is not null").select("code", "date", F.explode(rows).alias("r")).select("code", "date", "r.*").filter("percent between 0 and 100.5")
    return recent(long, ["code"], "date", days)


def out_of_range(feed: DataFrame) -> DataFrame:
    """A row per value outside 0 to 100."""
    rows = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in VALUES))
    return feed.select("code", "date", F.explode(rows).alias("r")).select("code", "date", "r.*").filter("value < 0 or value > 100")


def stale_codes(feed: DataFrame) -> DataFrame:
    """Codes with any row whose issued-share base may be out of date."""
    return dual_basis(feed).groupBy("code").agg(F.bool_or("issued_may_be_stale").alias("any_stale"))


def with_fallback(feed: DataFrame, ranked: DataFrame) -> DataFrame:
    """The feed, and for codes without any row one made of the latest holdings' cumulative stakes, marked estimated."""
    latest = ranked.join(ranked.groupBy("code").agg(F.max("date").alias("date")), ["code", "date"])
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("cumulative_bps") / 10000.0))
    made = latest.groupBy("code", "date").agg(at(5).alias("top5_pct"), at(10).alias("top10_pct"), F.lit(None).cast("double").alias("top10_ncip_pct"), (F.max("cumulative_bps") / 10000.0).alias("stake_pct"))
    missing = made.join(feed.select("code").distinct(), "code", "left_anti")
    return feed.select("code", "date", *VALUES, F.lit(False).alias("estimated")).unionByName(missing.withColumn("estimated", F.lit(True)))
