"""Daily prices: one row per (code, date, price_source)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shareflow.functions.scalars import change_percent, hk_amount, numeric_amount, parse_date, price_text, share_amount, signed_percent
from shareflow.operators.tables import limited, recent

#: A longer gap between records counts as a suspension, in days.
LONGEST_GAP = 10


def latest_prices(prices: DataFrame, limit: int | None = 90) -> DataFrame:
    """The latest rows of each code, newest first, with vwap_est where the source estimates turnover; all rows for None."""
    latest = limited(prices, ["code"], [F.desc("date"), F.asc("price_source")], limit, "row_number")
    return latest.withColumn("vwap_est", F.when((F.col("price_source") == "yahoo") & F.col("vwap").isNull(), F.try_divide("turnover_est", F.nullif("volume", F.lit(0)))))


def price_table(bars: DataFrame) -> DataFrame:
    """A price table from daily bars: prices to three decimals, missing volume as 0, turnover and VWAP estimated."""
    rounded = bars.withColumns({c: F.round(c, 3) for c in ("open", "high", "low", "close")}).withColumn("volume", F.coalesce("volume", F.lit(0)).cast("long"))
    turnover = F.round(F.col("close") * F.col("volume"), 2)
    out = rounded.withColumns({"turnover_est": turnover, "price_source": F.lit("yahoo")})
    return out.withColumn("vwap_est", F.round(F.try_divide("turnover_est", F.nullif("volume", F.lit(0))), 3))


def chart_frame(prices: DataFrame, days: int | None = 365) -> DataFrame:
    """Daily change, distance from VWAP, gap to the record before, and the number of suspensions before, per code."""
    order = Window.partitionBy("code").orderBy("date", "price_source")
    kept = recent(prices.filter("date is not null and close is not null"), ["code"], "date", days)
    gap = F.coalesce(F.datediff("date", F.lag("date").over(order)), F.lit(1))
    out = kept.withColumns({"daily_change_pct": change_percent(F.col("close"), F.lag("close").over(order)), "close_vs_vwap_pct": change_percent(F.col("close"), F.col("vwap")), "gap_days": gap})
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.withColumn("segment", F.sum(F.when(F.col("gap_days") > LONGEST_GAP, 1).otherwise(0)).over(so_far))


def with_labels(chart: DataFrame) -> DataFrame:
    """Display texts of a chart frame."""
    return chart.withColumns(
        {
            "close_label": price_text(F.col("close")),
            "vwap_label": price_text(F.col("vwap")),
            "turnover_label": hk_amount(F.col("turnover")),
            "volume_label": share_amount(F.col("volume")),
            "daily_change_label": signed_percent(F.col("daily_change_pct")),
            "close_vs_vwap_label": signed_percent(F.col("close_vs_vwap_pct")),
        }
    )


def suspensions(chart: DataFrame, longest: int = LONGEST_GAP) -> DataFrame:
    """Start and end of each gap of more than `longest` days."""
    return chart.filter(F.col("gap_days") > longest).select("code", F.date_sub("date", F.col("gap_days")).alias("start_date"), F.col("date").alias("end_date"))


def _cents(turnover: str) -> Column:
    """Turnover in whole hundredths: sums don't depend on the order of additions."""
    return F.floor(F.col(turnover) * 100)


def trailing_turnover(prices: DataFrame, rows: int = 20) -> DataFrame:
    """Each row's turnover against the mean of the last `rows` known turnovers of its code up to it.

    Known values are numbered along the code's rows; the mean is over a range of these numbers, so rows without turnover
    take up no place.
    """
    so_far = Window.partitionBy("code").orderBy("date", "price_source").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = prices.select("code", "date", "price_source", "turnover", F.count("turnover").over(so_far).alias("_known"))
    back = Window.partitionBy("code").orderBy("_known").rangeBetween(1 - rows, Window.currentRow)
    mean = F.try_divide(F.sum(_cents("turnover")).over(back), F.count("turnover").over(back) * 100.0)
    out = numbered.withColumn("mean_turnover", mean).drop("_known")
    return out.withColumn("turnover_vs_mean_pct", F.try_divide("turnover", "mean_turnover") * 100)


def price_stats(prices: DataFrame, shares: DataFrame | None = None) -> DataFrame:
    """Per code: the latest record, its change, its turnover against the mean of the last 20 known, its volume by issued shares."""
    back = Window.partitionBy("code").orderBy(F.desc("date"), F.desc("price_source"))
    ranked = prices.filter("date is not null and close is not null").withColumn("n", F.row_number().over(back))
    known = Window.partitionBy("code").orderBy(F.desc("date"), F.desc("price_source")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ranked.withColumn("known", F.count("turnover").over(known))
    at = lambda c, k: F.max(F.when(F.col("n") == k, F.col(c)))
    recent_turnover = F.when((F.col("known") <= 20) & F.col("turnover").isNotNull(), _cents("turnover"))
    stats = ranked.groupBy("code").agg(
        at("date", 1).alias("date"),
        at("close", 1).alias("close"),
        at("close", 2).alias("previous_close"),
        at("vwap", 1).alias("vwap"),
        at("volume", 1).alias("volume"),
        at("turnover", 1).alias("turnover"),
        F.try_divide(F.sum(recent_turnover), F.count(recent_turnover) * 100.0).alias("mean_turnover"),
    )
    stats = stats.withColumns(
        {
            "daily_change_pct": change_percent(F.col("close"), F.col("previous_close")),
            "close_vs_vwap_pct": change_percent(F.col("close"), F.col("vwap")),
            "turnover_vs_mean_pct": F.try_divide("turnover", "mean_turnover") * 100,
        }
    )
    if shares is None:
        return stats
    return stats.join(shares.select("code", "issued_shares"), "code", "left").withColumn("turnover_rate_pct", F.try_divide(F.col("volume") * 100.0, F.col("issued_shares")))


def price_lines(chart: DataFrame) -> DataFrame:
    """Rows per line of a chart: close and VWAP, with their segment."""
    rows = F.array(*(F.struct(F.lit(name).alias("series"), F.col(c).alias("price")) for name, c in (("Close", "close"), ("VWAP", "vwap"))))
    return chart.select("code", "date", "segment", F.explode(rows).alias("r")).select("code", "date", "segment", "r.*").filter("price is not null")


def bar_values(chart: DataFrame, mode: str = "turnover") -> DataFrame:
    """Bars of a chart in millions: turnover or volume."""
    return chart.select("code", "date", (F.col(mode) / 1e6).alias("millions")).filter("millions is not null")


def with_share_capital(prices: DataFrame, capital: DataFrame, meta: DataFrame) -> DataFrame:
    """Add issued shares from the latest share-capital record, else from the stock's own data, and say which; then market cap."""
    a = capital.select("code", F.col("shares").alias("_capital"), F.col("as_of").alias("_capital_date"))
    b = meta.select("code", F.col("issued_shares").alias("_meta"), F.col("issued_shares_as_of").alias("_meta_date"))
    out = prices.join(a, "code", "left").join(b, "code", "left").withColumns(
        {
            "issued_shares": F.coalesce("_capital", "_meta"),
            "issued_as_of": F.when(F.col("_capital").isNotNull(), F.col("_capital_date")).otherwise(F.col("_meta_date")),
            "issued_source": F.when(F.col("_capital").isNotNull(), "share_changes").when(F.col("_meta").isNotNull(), "stock_meta"),
        }
    )
    cap = F.col("close") * F.col("issued_shares")
    return out.drop("_capital", "_capital_date", "_meta", "_meta_date").withColumns({"market_cap": cap, "turnover_to_cap_pct": F.try_divide(F.col("turnover") * 100, cap)})


def overlay(prices: DataFrame, cost_lines: DataFrame) -> DataFrame:
    """Each (code, label, price) line as two points, at the first and the last date of the code's prices."""
    ends = prices.groupBy("code").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    return cost_lines.join(ends, "code").select("code", "label", "price", F.explode(F.array_distinct(F.array("first", "last"))).alias("date"))


def _lines(texts: DataFrame) -> DataFrame:
    return texts.select("code", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("line_no", "line"))


def parse_cost_lines(texts: DataFrame) -> DataFrame:
    """`label,price` lines of a text column as rows: the second field is an amount (HK$1.2, 3K, 1.5M), further ones don't count.

    A blank label is `Cost line`; lines without a second field or with one that is no amount are left out.
    """
    rows = _lines(texts).withColumn("_fields", F.split("line", ",", -1))
    label, amount = F.trim(F.get("_fields", F.lit(0))), numeric_amount(F.get("_fields", F.lit(1)))
    return rows.select("code", "line_no", F.when(label == "", "Cost line").otherwise(label).alias("label"), amount.alias("price")).filter("price is not null")


def parse_event_markers(texts: DataFrame) -> DataFrame:
    """`date,label` lines of a text column as rows, the date in any common form; lines without a date are left out."""
    rows = _lines(texts)
    return rows.select("code", "line_no", parse_date(F.regexp_extract("line", "^([^,]*),(.*)$", 1)).alias("date"), F.trim(F.regexp_extract("line", "^([^,]*),(.*)$", 2)).alias("label")).filter("date is not null")
