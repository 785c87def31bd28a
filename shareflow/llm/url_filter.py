"""URL filters by dated lists: a temporal join with DataFrame operations alone.

A list is a log of dated entries: from its date on, a pattern is added to or removed from the list. The log becomes
validity intervals [from, to), and every capture is evaluated against the entries that were active when it was fetched.

A pattern is a domain (it matches that host and all hosts below it) or `host/segment` (it matches that exact host when the
first path segment of the URL is `segment`; case counts there). One capture has at most as many keys as its host has labels, plus one, so
the as-of join is an equi-join on keys with a date range. Keys are counted first: a key of more than HOT_SHARE of all
captures is spread over as many salts as it has such shares, with a copy of its intervals for each; there are at most
(keys of a capture) / HOT_SHARE salts in all, so the hot keys are a small table that is broadcast.

- a null, empty or unparsable URL has a null host and matches nothing; hosts of over 253 characters are invalid and null;
- a capture without fetch date matches nothing; entries with a null pattern, date, list or unknown action are ignored;
- of entries of one day for one pattern, removal comes last; repeated entries count once;
- rows that repeat a capture (id, url and date) give one row; no entries: nothing is blocked; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shareflow.llm.common import HOT_SHARE, written

AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
SEGMENT = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*/([^/?#]+)"


def intervals(entries: DataFrame) -> DataFrame:
    """list_name, pattern, valid_from, valid_to (null: still valid) of a log of list_name, pattern, action, effective_on."""
    known = entries.select("list_name", "pattern", "action", "effective_on")
    known = known.filter("action in ('add', 'remove')").dropna().distinct()
    order = Window.partitionBy("list_name", "pattern").orderBy("effective_on", "action")
    spans = known.withColumn("valid_to", F.lead("effective_on").over(order))
    return spans.filter("action = 'add' and (valid_to is null or valid_to > effective_on)").select("list_name", "pattern", F.col("effective_on").alias("valid_from"), "valid_to")


def with_keys(captures: DataFrame) -> DataFrame:
    """Captures with the host of their url and the array of patterns that would match it."""
    found = F.regexp_replace(F.lower(F.regexp_extract("url", AUTHORITY, 1)), r"\.$", "")
    host = F.when((F.length(found) > 0) & (F.length(found) <= 253), found)
    segment = F.regexp_extract("url", SEGMENT, 1)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = F.when(F.col("host").isNull(), F.array().cast("array<string>")).otherwise(
        F.concat(suffixes, F.when(F.length(segment) > 0, F.array(F.concat_ws("/", "host", segment))).otherwise(F.array().cast("array<string>")))
    )
    return captures.withColumn("host", host).withColumn("keys", keys)


def hot_keys(captures: DataFrame) -> DataFrame:
    """hot_key (null: no host) and salts of each key of more than HOT_SHARE of the captures."""
    share = max(captures.count() * HOT_SHARE, 1.0)
    counted = with_keys(captures.select("url")).select(F.explode_outer("keys").alias("hot_key")).groupBy("hot_key").count()
    return written(counted.filter(F.col("count") > share).select("hot_key", F.ceil(F.col("count") / share).cast("int").alias("salts")), "hot-keys")


def url_filter(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, url, fetched_on, host, blocked, lists (sorted), n_entries: a row per distinct capture."""
    hot = hot_keys(captures)
    keyed = with_keys(captures.select("page_id", "url", "fetched_on").distinct())
    probe = keyed.select("page_id", "url", "fetched_on", "host", F.explode_outer("keys").alias("key"))
    salts = F.coalesce("salts", F.lit(1))
    probe = probe.join(F.broadcast(hot), F.col("key").eqNullSafe(F.col("hot_key")), "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "fetched_on"), salts).cast("int"))
    spans = intervals(entries).join(F.broadcast(hot), F.col("pattern") == F.col("hot_key"), "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    active = (F.col("c.key") == F.col("e.pattern")) & (F.col("c.salt") == F.col("e.salt")) & (F.col("fetched_on") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_on") < F.col("valid_to")))
    joined = probe.drop("hot_key", "salts").alias("c").join(spans.drop("hot_key", "salts").alias("e"), active, "left")
    return joined.groupBy("page_id", "url", "fetched_on", "host").agg(
        (F.count("pattern") > 0).alias("blocked"),
        F.concat_ws(",", F.array_sort(F.collect_set("list_name"))).alias("lists"),
        F.count("pattern").alias("n_entries"),
    )


def derived_entries(pages: DataFrame) -> DataFrame:
    """The rows of ENTRIES_SQL in one scan: page_id and url make list_name, pattern, action, effective_on."""
    host = F.lower(F.regexp_extract("url", AUTHORITY, 1))
    segment = F.regexp_extract("url", SEGMENT, 1)

    def named(list_name, pattern):
        return F.struct(F.lit(list_name).alias("list_name"), pattern.alias("pattern"))

    domain = F.regexp_extract(host, r"([^.]+[.][^.]+)$", 1)
    path = F.when(segment != "", F.concat(host, F.lit("/"), segment))
    names = pages.select(F.inline(F.array(named("hosts", host), named("paths", path), named("domains", domain)))).filter("pattern <> ''").distinct()
    digest = F.md5(F.concat("list_name", F.lit(":"), "pattern"))

    def digit(place):
        return F.ascii(F.substring(digest, place, 1))

    start, days, twice = digit(1) * 7 % 256, digit(2) % 90 + 10, digit(4) % 2 == 0

    def dated(action, after):
        return F.struct(F.lit(action).alias("action"), F.date_add(F.lit("2024-01-01").cast("date"), after).alias("effective_on"))

    log = F.when(twice, F.array(dated("add", start), dated("remove", start + days), dated("add", start + 2 * days))).otherwise(F.array(dated("add", start)))
    return names.filter(digit(3) % 3 != 0).select("list_name", "pattern", F.inline(log))


#: Captures and list entries that derive from `pages`, in SQL (for the entries, derived_entries gives the same rows): pages are fetched over a year; each
#: host is listed, or its first path segment or its registered domain is, on days that follow from a digest of the name.
CAPTURES_SQL = "select page_id, url, date '2024-01-01' + cast(page_id % 366 as int) as fetched_on from pages"
ENTRIES_SQL = r"""
with parts as (
  select distinct lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1)) as host,
         regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*/([^/?#]+)', 1) as segment
  from pages),
named as (
  select 'hosts' as list_name, host as pattern from parts
  union select 'paths', concat(host, '/', segment) from parts where segment <> ''
  union select 'domains', regexp_extract(host, '([^.]+[.][^.]+)$', 1) from parts),
hashed as (
  select list_name, pattern, md5(concat(list_name, ':', pattern)) as h from named where pattern <> '' ),
days as (
  select list_name, pattern, h, ascii(substr(h, 1, 1)) * 7 % 256 as start_day, ascii(substr(h, 2, 1)) % 90 + 10 as n_days from hashed where ascii(substr(h, 3, 1)) % 3 <> 0)
select list_name, pattern, 'add' as action, date '2024-01-01' + cast(start_day as int) as effective_on from days
union all select list_name, pattern, 'remove', date '2024-01-01' + cast(start_day + n_days as int) from days where ascii(substr(h, 4, 1)) % 2 = 0
union all select list_name, pattern, 'add', date '2024-01-01' + cast(start_day + 2 * n_days as int) from days where ascii(substr(h, 4, 1)) % 2 = 0
"""

ORACLE = (
    "with captures as ("
    + CAPTURES_SQL
    + "), entries as ("
    + ENTRIES_SQL
    + r"""),
spans as (
  select *, lead(effective_on) over (partition by list_name, pattern order by effective_on, action) as valid_to from (select distinct * from entries)),
active as (
  select list_name, pattern, effective_on as valid_from, valid_to from spans where action = 'add' and (valid_to is null or valid_to > effective_on)),
hosts as (
  select distinct page_id, url, fetched_on,
    nullif(regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1)), '[.]$', ''), '') as host,
    regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*/([^/?#]+)', 1) as segment
  from captures),
keyed as (
  select page_id, url, fetched_on, host, i.pattern, i.list_name
  from hosts h left join active i
    on (h.host = i.pattern or ends_with(h.host, '.' || i.pattern) or h.host || '/' || h.segment = i.pattern)
   and h.fetched_on >= i.valid_from and (i.valid_to is null or h.fetched_on < i.valid_to))
select page_id, url, fetched_on, host, count(pattern) > 0 as blocked,
  coalesce(string_agg(distinct list_name, ',' order by list_name), '') as lists, count(pattern) as n_entries
from keyed group by 1, 2, 3, 4
"""
)
