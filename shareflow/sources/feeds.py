"""JSON and CSV feeds into rows: watchlists, category rules, issue ids, daily bars, announcements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shareflow.functions import scalars
from shareflow.operators.tables import first_rows

def read_watchlist(spark: SparkSession, path: str, group: str = "", header: bool = True) -> DataFrame:
    """code, name, groups of a CSV watchlist with or without a header line; the first row of a code counts."""
    if header:
        rows = spark.read.option("header", True).csv(path)
        have = lambda c: F.col(c) if c in rows.columns else F.lit("")
        rows = rows.select(F.col("code"), have("name").alias("name"), have("group").alias("group_text"))
    else:
        rows = spark.read.schema("code string, name string, group_text string").option("enforceSchema", True).csv(path)
    return watchlist_rows(rows, group)


def read_watchlist_json(spark: SparkSession, path: str, group: str = "") -> DataFrame:
    """The same of a JSON list of codes or objects, or an object whose `codes` holds such a list."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    items = F.coalesce(F.from_json(F.when(F.col("value").startswith("["), F.col("value")), "array<string>"), F.from_json(F.get_json_object("value", "$.codes"), "array<string>"))
    item = text.select(F.posexplode(items).alias("seq", "item"))
    is_object = F.col("item").startswith("{")
    field = lambda n: F.when(is_object, F.coalesce(F.get_json_object("item", f"$.{n}"), F.lit("")))
    rows = item.select("seq", F.coalesce(field("code"), F.col("item")).alias("code"), F.coalesce(field("name"), F.lit("")).alias("name"), F.coalesce(field("group"), F.lit("")).alias("group_text"))
    return watchlist_rows(rows, group)


def watchlist_rows(rows: DataFrame, group: str = "") -> DataFrame:
    """Clean codes and groups, keep the members of a group (all if it is blank), the first row of each code."""
    seq = F.col("seq") if "seq" in rows.columns else F.monotonically_increasing_id()
    clean = rows.select(seq.alias("seq"), scalars.stock_code(F.col("code")).alias("code"), F.trim(F.coalesce("name", F.lit(""))).alias("name"), scalars.groups(F.col("group_text")).alias("groups")).filter("code <> ''")
    member = clean.filter(F.array_contains("groups", group.strip().lower())) if group.strip() else clean
    return first_rows(member, ["code"], [F.asc("seq")]).drop("seq")


def read_category_rules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The id table (participant_id, category) and the keyword table (priority, keyword, category) of a JSON configuration."""
    text = spark.read.text(path, wholetext=True)
    ids = text.select(F.explode(F.from_json(F.get_json_object("value", "$.by_ccass_id"), "map<string,string>")).alias("k", "category"))
    words = text.select(F.posexplode(F.from_json(F.get_json_object("value", "$.by_name_keyword"), "map<string,string>")).alias("priority", "k", "category"))
    return ids.select(F.upper(F.trim("k")).alias("participant_id"), "category"), words.select("priority", F.upper(F.trim("k")).alias("keyword"), "category")


def with_issue_id(rows: DataFrame, issues: DataFrame) -> DataFrame:
    """Add the issue id of each code (null if unknown)."""
    return rows.join(issues.select("code", "issue_id"), "code", "left")


def codes_of_issues(rows: DataFrame, issues: DataFrame) -> DataFrame:
    """Add the code of each issue id (null if unknown)."""
    return rows.join(issues.select("issue_id", "code"), "issue_id", "left")


def active_stocks(requests: DataFrame, stocks: DataFrame) -> DataFrame:
    """Listing id and name of requested codes in whatever form, by cleaned code."""
    known = stocks.select(scalars.stock_code(F.col("code")).alias("code"), "listing_id", "name")
    return requests.withColumn("code", scalars.stock_code(F.col("code"))).join(known, "code", "left")


def _kind(value: Column) -> Column:
    """The first word of a variant's type: ARRAY, OBJECT, STRING, VOID for a JSON null, …; null for no value."""
    return F.regexp_extract(F.schema_of_variant(value), "^([A-Z]+)", 1)


def _part(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def daily_bars(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bars (code, date in Hong Kong, open … volume) of chart payloads (code, json), and (code, error) of those without.

    Payloads may have any form: one that is no JSON is `malformed payload`, one with an error object has its description,
    one without timestamps (null, empty, another object) `no data`. A value that is no number is null and costs only its
    own place; columns may be shorter than the timestamps.
    """
    chart = payloads.select("code", F.try_parse_json("json").alias("p"), F.col("json").alias("_json"))
    quote = "$.chart.result[0].indicators.quote[0]"
    fault, stamps = _part(F.col("p"), "$.chart.error"), _part(F.col("p"), "$.chart.result[0].timestamp", "array<bigint>")
    described = F.coalesce(_part(fault, "$.description", "string"), _part(fault, "$.code", "string"), F.lit("error"))
    blank = F.trim(F.coalesce("_json", F.lit(""))) == ""
    error = F.when(~blank & F.col("p").isNull(), "malformed payload").when(fault.isNotNull() & (_kind(fault) != "VOID"), described).when(F.size(F.coalesce("ts", F.array().cast("array<bigint>"))) == 0, "no data")
    # texts first, so that one bad value doesn't spoil its column
    texts = lambda c: F.coalesce(_part(F.col("p"), f"{quote}.{c}", "array<string>"), F.array().cast("array<string>"))
    numbers = lambda c, kind: F.transform(texts(c), lambda x: x.try_cast("double").cast(kind)).alias(c)
    columns = {"open": "double", "high": "double", "low": "double", "close": "double", "volume": "bigint"}
    one = chart.withColumn("ts", stamps).select("code", error.alias("error"), "ts", *(numbers(c, kind) for c, kind in columns.items()))
    rows = one.filter("error is null").select("code", F.explode(F.arrays_zip("ts", *columns)).alias("b")).filter("b.ts is not null")
    day = F.to_date(F.from_utc_timestamp(F.timestamp_seconds("b.ts"), "Asia/Hong_Kong"))
    return rows.select("code", day.alias("date"), *(f"b.{c}" for c in columns)), one.select("code", "error").filter("error is not null")


NEWS = ["NEWS_ID", "DATE_TIME", "STOCK_CODE", "STOCK_NAME", "LONG_TEXT", "SHORT_TEXT", "TITLE", "FILE_INFO", "FILE_TYPE", "FILE_LINK"]


def _results(payloads: DataFrame) -> DataFrame:
    """All columns of payloads, `items` (the variant that holds the announcements, null without any) and `error`.

    `result` may be a list or a text that holds one; absent, null, "null" and blank mean that there are none.
    """
    payload = F.try_parse_json("json")
    given = payloads.withColumns({"_payload": payload, "_result": _part(payload, "$.result"), "_error": _part(payload, "$.error")})
    text = F.when(_kind(F.col("_result")) == "STRING", F.trim(_part(F.col("_result"), "$", "string")))
    inner = F.when(text.isNotNull(), F.when(~text.isin("", "null"), F.try_parse_json(text))).otherwise(F.col("_result"))
    is_list, empty = _kind(F.col("_inner")) == "ARRAY", F.coalesce(_kind(F.col("_result")), F.lit("VOID")) == "VOID"
    stated = F.coalesce(_part(F.col("_error"), "$.message", "string"), _part(F.col("_error"), "$", "string"), F.to_json("_error"))
    error = (
        F.when((F.trim(F.coalesce("json", F.lit(""))) != "") & F.col("_payload").isNull(), "malformed payload")
        .when(F.col("_error").isNotNull() & (_kind(F.col("_error")) != "VOID"), stated)
        .when(text.isNotNull() & ~text.isin("", "null") & F.col("_inner").isNull(), "malformed result")
        .when(F.col("_inner").isNotNull() & ~is_list & ~empty, "result is no list")
    )
    return given.withColumn("_inner", inner).select(*payloads.columns, F.when(is_list, F.col("_inner")).alias("items"), error.alias("error"))


def announcement_errors(payloads: DataFrame) -> DataFrame:
    """The payloads (json and any columns) that can't be read or state an error, with `error`."""
    return _results(payloads).filter("error is not null").drop("items")


def announcements(payloads: DataFrame, site: str) -> DataFrame:
    """Announcements of search payloads (json): `result` may be a list or a text that holds one; texts lose their tags."""
    found = _results(payloads.select("json")).filter("items is not null").select("items")
    items = payloads.sparkSession.sql("select e.value as n from {found} p, lateral variant_explode(p.items) e", found=found)
    items = items.select(*(_part(F.col("n"), f"$.{c}", "string").alias(c) for c in NEWS))
    plain = lambda c: scalars.strip_tags(F.coalesce(F.col(c), F.lit("")))
    stamp = F.coalesce(F.try_to_timestamp("DATE_TIME", F.lit("dd/MM/yyyy HH:mm")), F.try_to_timestamp("DATE_TIME", F.lit("yyyy-MM-dd HH:mm")))
    return items.select(
        F.col("NEWS_ID").alias("news_id"),
        stamp.alias("publish_time"),
        scalars.stock_code(F.col("STOCK_CODE")).alias("code"),
        plain("STOCK_NAME").alias("stock_name"),
        F.coalesce(F.nullif(plain("LONG_TEXT"), F.lit("")), plain("SHORT_TEXT")).alias("category"),
        plain("TITLE").alias("title"),
        F.col("FILE_INFO").alias("file_info"),
        F.col("FILE_TYPE").alias("file_type"),
        F.when(F.col("FILE_LINK") != "", scalars.absolute_link(F.col("FILE_LINK"), site)).alias("url"),
    )
