"""Scalar functions over Columns: cleaning of codes, names, numbers, dates and texts, and display formats.

All are built-in expressions; bad input gives null, never an error. Regexes use Unicode classes where text can be Chinese.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"(-?\d+(?:\.\d+)?)"


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def clean_text(c: Column) -> Column:
    """Runs of white space, no-break spaces included, become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(F.replace(c, F.lit(" "), F.lit(" ")), r"(?U)\s+", " "))


def normal_name(c: Column) -> Column:
    """Lower case letters, digits, % and + with single spaces: the form in which headers and keywords are compared."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9%+]+", " "))


def strip_tags(c: Column) -> Column:
    return clean_text(F.regexp_replace(c, r"<[^>]*>", " "))


def dash_to_null(c: Column) -> Column:
    """Null for text that is blank, - or --."""
    plain = clean_text(c)
    return F.when(~plain.isin("", "-", "--"), plain)


def stock_code(c: Column) -> Column:
    """Digits only, padded with zeros to five; longer codes stay whole; no digits give ''."""
    digits = F.regexp_replace(c, r"\D", "")
    return F.when(digits == "", "").when(F.length(digits) >= 5, digits).otherwise(F.lpad(digits, 5, "0"))


def participant_id(c: Column) -> Column:
    """The first A-C followed by five digits anywhere in the text, upper case; '' if there is none."""
    return F.upper(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)([A-C]\d{5})", 1))


def is_participant_id(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(r"^[A-Ca-c]\d{5}$"), F.lit(False))


def participant_name(c: Column) -> Column:
    """Without the labels that registry pages print before a name."""
    text = F.trim(F.coalesce(c, F.lit("")))
    text = F.regexp_replace(text, r"(?i)^name\s+of\s+ccass\s+participant\s*\(\*\s*for\s*consenting\s*investor\s*participants\s*\)\s*:?\s*", "")
    return F.trim(F.regexp_replace(text, r"(?i)^participant\s+name\s*:?\s*", ""))


def participant_label(name: Column, pid: Column) -> Column:
    plain = clean_text(F.coalesce(name, F.lit("")))
    plain = F.replace(F.replace(plain, F.lit("(HONG KONG)"), F.lit("(HK)")), F.lit("COMPANY LIMITED"), F.lit("CO LTD"))
    short = F.when(F.length(plain) > 34, F.concat(F.rtrim(F.substring(plain, 1, 31)), F.lit("..."))).otherwise(plain)
    return F.when(F.coalesce(pid, F.lit("")) != "", F.concat(short, F.lit(" ("), pid, F.lit(")"))).otherwise(short)


def to_number(c: Column) -> Column:
    """The first decimal in a text after , % and + are dropped."""
    return F.regexp_extract(F.regexp_replace(c, r"[,%+]", ""), NUMBER, 1).try_cast("double")


def whole_number(c: Column) -> Column:
    """The first integer in a text without commas; 0 if there is none."""
    return F.coalesce(F.regexp_extract(F.regexp_replace(c, ",", ""), r"(-?\d+)", 1).try_cast("bigint"), F.lit(0))


def percent(c: Column) -> Column:
    """The first decimal in a text without commas and %; null if there is none."""
    return F.regexp_extract(F.regexp_replace(c, "[,%]", ""), NUMBER, 1).try_cast("double")


def first_int(c: Column) -> Column:
    return F.regexp_extract(c, r"(-?\d+)", 1).try_cast("int")


def numeric_percent(c: Column) -> Column:
    """A percentage that makes up the whole text."""
    return F.trim(F.regexp_replace(c, "[,%]", "")).try_cast("double")


def numeric_amount(c: Column) -> Column:
    """An amount such as HK$1.2M: currency signs are dropped, K, M and B multiply."""
    text = F.trim(F.regexp_replace(F.upper(c), r"HK\$|[$,]", ""))
    unit = F.when(text.endswith("K"), 1e3).when(text.endswith("M"), 1e6).when(text.endswith("B"), 1e9).otherwise(1.0)
    return F.trim(F.regexp_replace(text, "[KMB]$", "")).try_cast("double") * unit


def percent_text(c: Column) -> Column:
    text = F.trim(F.coalesce(c, F.lit("")))
    return F.when(text == "", "").when(text.contains("%"), text).otherwise(F.concat(text, F.lit("%")))


def parse_date(c: Column) -> Column:
    """yy-mm-dd as 20yy, then the common whole-text formats; null for anything else."""
    text = F.trim(c)
    short = F.when(text.rlike(r"^\d{2}-\d{2}-\d{2}$"), F.try_to_date(F.concat(F.lit("20"), text), "yyyy-MM-dd"))
    formats = ["yyyy-M-d", "yyyy/M/d", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "yyyyMMdd", "dd/MM/yyyy"]
    shapes = [r"^\d{4}-\d{1,2}-\d{1,2}$", r"^\d{4}/\d{1,2}/\d{1,2}$", r"^\d{1,2} [A-Za-z]{3} \d{4}$", r"^\d{1,2} [A-Za-z]{4,} \d{4}$", r"^[A-Za-z]{3} \d{1,2}, \d{4}$", r"^\d{8}$", r"^\d{2}/\d{2}/\d{4}$"]
    return F.coalesce(short, *(F.when(text.rlike(s), F.try_to_date(text, f)) for s, f in zip(shapes, formats, strict=True)))


def ticker(code: Column) -> Column:
    """NNNN.HK, with at least four digits."""
    return F.concat(_padded(code, 4), F.lit(".HK"))


def slug(code: Column) -> Column:
    """HKNNNN, with at least four digits."""
    return F.concat(F.lit("HK"), _padded(code, 4))


def _padded(code: Column, n: int) -> Column:
    bare = F.regexp_replace(F.regexp_replace(code, r"\D", ""), "^0+", "")
    return F.when(F.length(bare) >= n, bare).otherwise(F.lpad(bare, n, "0"))


def absolute_link(href: Column, base: str, folder: str = "") -> Column:
    """A link as it is if absolute, else below the site (leading /) or below a folder of it."""
    return F.when(href.startswith("http"), href).when(href.startswith("/"), F.concat(F.lit(base), href)).otherwise(F.concat(F.lit(f"{base}/{folder}"), href))


def period_bucket(days: Column) -> Column:
    """The shortest named period that covers a number of days."""
    out = F.when(days <= 5, "5d")
    for most, name in ((31, "1mo"), (93, "3mo"), (186, "6mo"), (366, "1y"), (731, "2y")):
        out = out.when(days <= most, name)
    return out.otherwise("5y")


def ratio_percent(top: Column, bottom: Column) -> Column:
    return F.round(F.try_divide(top, bottom) * 100, 4)


def market_cap(close: Column, shares: Column) -> Column:
    return F.round(close * shares, 2)


def vwap_estimate(source: Column, vwap: Column, turnover: Column, volume: Column) -> Column:
    """Turnover by volume, only where the source doesn't give a VWAP of its own."""
    return F.when((F.lower(source) == "yahoo") & vwap.isNull(), F.round(F.try_divide(turnover, F.nullif(volume, F.lit(0))), 3)).otherwise(vwap)


def change_percent(now: Column, before: Column) -> Column:
    return F.try_divide(now - before, before) * 100


def hk_amount(v: Column) -> Column:
    return _scaled(v, "HK$", "", ("%.2f", "%.2f", "%.1f"))


def share_amount(v: Column) -> Column:
    return _scaled(v, "", " shares", ("%.2f", "%.2f", "%.0f"))


def _scaled(v: Column, before: str, after: str, formats: tuple[str, str, str]) -> Column:
    out = F.when(v.isNull() | F.isnan(v.cast("double")), "-")
    for least, unit, form in zip((1e9, 1e6, 1e3), "BMK", formats, strict=True):
        out = out.when(F.abs(v) >= least, F.format_string(f"{before}{form}{unit}{after}", v.cast("double") / least))
    return out.otherwise(F.format_string(f"{before}%,.0f{after}", v.cast("double")))


def price_text(v: Column) -> Column:
    plain = F.regexp_replace(F.format_string("HK$%.4f", v.cast("double")), r"\.?0+$", "")
    return F.when(v.isNull() | F.isnan(v.cast("double")), "-").otherwise(plain)


def signed_percent(v: Column) -> Column:
    return F.when(v.isNull() | F.isnan(v.cast("double")), "-").otherwise(F.concat(F.when(v > 0, "+").otherwise(""), F.format_string("%.2f%%", v.cast("double"))))


def groups(c: Column) -> Column:
    """Names split at ; or |, trimmed and lower case, first occurrences in order."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"[;|]"), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.array_remove(parts, ""))


def looks_like_issue_id(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(r"^[1-9]\d{3,7}$"), F.lit(False))


def date_from_path(url: Column, as_of: Column) -> Column:
    """struct(date, note): the /YYYY/MMDD/ of an announcement's path, or as_of with a note that says so."""
    found = F.try_to_date(F.concat(F.regexp_extract(url, r"/(\d{4})/(\d{4})/", 1), F.regexp_extract(url, r"/(\d{4})/(\d{4})/", 2)), "yyyyMMdd")
    return F.struct(F.coalesce(found, as_of).alias("date"), F.when(found.isNull(), "no date in the path; as-of date used").alias("note"))


def clean_extracted(c: Column) -> Column:
    """Text of a document without NUL and replacement characters and without blanks at line ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[\\x00�]", ""), r"(?m)[ \t\r]+$", ""))


def truncated(c: Column, limit: int) -> Column:
    """struct(head, chars_total, chars_returned, truncated)."""
    total = F.length(c).cast("long")
    return F.struct(F.substring(c, 1, limit).alias("head"), total.alias("chars_total"), F.least(total, F.lit(limit).cast("long")).alias("chars_returned"), (total > limit).alias("truncated"))


def text_quality(c: Column) -> Column:
    """struct(score, visible): tens for each Han character, one for each ASCII letter or digit, minus twenty for each U+FFFD."""
    count = lambda pattern: (F.length(c) - F.length(F.regexp_replace(c, pattern, ""))).cast("long")
    score = count(r"[一-鿿]") * 10 + count("[A-Za-z0-9]") - count("�") * 20
    return F.struct(score.alias("score"), F.length(F.regexp_replace(c, r"(?U)\s+", "")).alias("visible"))


def better_text(c: Column) -> Column:
    """What to order candidate texts by, the best first: score, then visible characters."""
    q = text_quality(c)
    return F.struct((-q["score"]).alias("score"), (-q["visible"]).alias("visible"))


def json_safe(c: Column) -> Column:
    """Null in place of NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def body_head(html: Column, limit: int = 500) -> Column:
    return F.substring(strip_tags(html), 1, limit)


def allowed_url(url: Column, hosts: list[str]) -> Column:
    """The URL without fragment if it is https, on one of hosts, at the default port and without credentials; else null."""
    return F.when(F.lower(F.try_parse_url(url, F.lit("HOST"))).isin(hosts), allowed_url_any_host(url))


def allowed_url_any_host(url: Column) -> Column:
    """The same for any host: a host rule of the caller's own comes on top."""
    part = lambda name: F.try_parse_url(url, F.lit(name))
    port = F.regexp_extract(part("AUTHORITY"), r":(\d+)$", 1)
    ok = (F.lower(part("PROTOCOL")) == "https") & port.isin("", "443") & part("USERINFO").isNull()
    query = part("QUERY")
    return F.when(ok, F.concat(F.lit("https://"), F.lower(part("HOST")), F.coalesce(part("PATH"), F.lit("")), F.when(query.isNotNull(), F.concat(F.lit("?"), query)).otherwise("")))


def tenure(c: Column) -> Column:
    """struct(tenure_from, tenure_to, is_current) of a text with one or two ISO dates or an 'until now' mark."""
    dates = F.regexp_extract_all(c, F.lit(r"(\d{4}-\d{2}-\d{2})"), F.lit(1))
    now = F.coalesce(c, F.lit("")).contains("至今")
    until = F.when(~now, F.try_to_date(F.try_element_at(dates, F.lit(2))))
    return F.struct(F.try_to_date(F.try_element_at(dates, F.lit(1))).alias("tenure_from"), until.alias("tenure_to"), until.isNull().alias("is_current"))


def person_intro(c: Column) -> Column:
    """struct(sex, age, education) of a text such as '男 52 本科'; of several words of a kind the last counts."""
    parts = F.array_remove(F.split(clean_text(c), " "), "")
    sex = F.filter(parts, lambda x: x.isin("男", "女"))
    age = F.filter(parts, lambda x: x.rlike(r"^\d+$"))
    rest = F.filter(parts, lambda x: ~x.isin("男", "女") & ~x.rlike(r"^\d+$"))
    last = lambda a: F.try_element_at(a, F.lit(-1))
    return F.struct(last(sex).alias("sex"), last(age).try_cast("int").alias("age"), last(rest).alias("education"))
