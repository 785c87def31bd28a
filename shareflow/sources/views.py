"""The library's tables as views over the driver's star schema, in SQL text that Spark and DuckDB both run.

Stakes are kept as integers: bps is ten-thousandths of a percent of the issued shares, rounded half up, so sums and
comparisons don't depend on the order of additions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shareflow.operators.tables import spread

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

#: View name and its SQL; a view may use the base tables and the views before it.
VIEWS: dict[str, str] = {
    "participants": """
        select s_suppkey as supplier, concat(case when s_suppkey % 5 = 0 then 'C' else 'B' end, lpad(cast(s_suppkey as string), 5, '0')) as participant_id,
               concat(n_name, ' ', s_name) as participant_name
        from supplier join nation on s_nationkey = n_nationkey""",
    "held": """
        select lpad(cast(l_partkey % 20 as string), 5, '0') as code,
               cast(last_day(cast(date_trunc('quarter', l_shipdate) as date) + interval '2' month) as date) as date,
               l_suppkey as supplier, cast(sum(cast(l_quantity as bigint)) as bigint) as shares
        from lineitem group by 1, 2, 3""",
    "issued": "select code, date, cast(sum(shares) * 5 as bigint) as issued from held group by 1, 2",
    "snapshots": """
        select h.code, h.date, p.participant_id, p.participant_name, h.shares,
               case when h.supplier % 17 = 0 then null else cast(floor((h.shares * 1000000 + floor(h.issued / 2)) / h.issued) as bigint) end as bps, h.issued
        from (select code, date, supplier, shares, cast(sum(shares) over (partition by code, date) * 5 as bigint) as issued from held) h
        join participants p on h.supplier = p.supplier""",
    "stock_meta": """
        select code, max(name) as name, max(issued) as issued_shares, max(date) as issued_shares_as_of
        from (select i.code, p.p_name as name, i.issued, i.date from issued i left join part p on lpad(cast(p.p_partkey as string), 5, '0') = i.code) x group by 1""",
    "ticks": """
        select lpad(cast(user_id as string), 5, '0') as code, cast(ts as date) as date, user_id % 3 = 0 as mirror, value,
               cast(regexp_extract(props, '"k": *(-?[0-9]+)', 1) as bigint) as k,
               row_number() over (partition by user_id, cast(ts as date) order by ts, event_id) as from_open,
               row_number() over (partition by user_id, cast(ts as date) order by ts desc, event_id desc) as from_close
        from events""",
    "price_history": """
        select code, date, case when mirror then 'mirror' else 'yahoo' end as price_source, open, high, low, close, volume,
               case when mirror then close * volume end as turnover, case when mirror then (high + low + close) / 3 end as vwap,
               case when not mirror then close * volume end as turnover_est
        from (select code, date, mirror, max(case when from_open = 1 then value end) as open, max(value) as high, min(value) as low,
                     max(case when from_close = 1 then value end) as close, cast(sum(k) as bigint) as volume
              from ticks group by 1, 2, 3) x""",
    "share_changes": """
        select lpad(cast(o_custkey % 200 as string), 5, '0') as code, o_orderkey as seq, cast(o_orderdate as date) as change_date,
               case when o_orderkey % 11 = 0 then null else o_totalprice end as shares_million,
               case o_orderpriority when '1-URGENT' then '配售新股' when '2-HIGH' then '供股及红股' when '3-MEDIUM' then '行使购股权, 注销回购'
                    when '4-NOT SPECIFIED' then '股份合并' else null end as reason
        from orders""",
    "buybacks": """
        select lpad(cast(o_custkey % 200 as string), 5, '0') as code, o_orderkey as seq, cast(o_orderdate as date) as buyback_date,
               o_totalprice as amount_wan, o_totalprice / 10 as shares_wan
        from orders""",
    "announcements": """
        select doc_id as news_id, lpad(cast(doc_id % 50 as string), 5, '0') as code, source as category,
               concat(replace(text, chr(10), ' '), case doc_id % 9 when 0 then ' Rights Issue' when 1 then ' Change of Directors' when 2 then ' 停牌'
                 when 3 then ' Annual Results' when 4 then ' Placing of New Shares' else '' end) as title,
               cast(date '2024-01-01' + cast(doc_id % 1500 as int) as date) as publish_date
        from documents""",
    "fetch_log": """
        select event_id as seq, lpad(cast(user_id as string), 5, '0') as code,
               case user_id % 4 when 0 then 'Holdings' when 1 then 'Changes' when 2 then 'Big Changes' else 'Price History' end as section,
               cast(ts as date) as fetched_on,
               case event_id % 13 when 0 then 'Connection refused' when 1 then 'Read timed out' when 2 then 'no matching table' when 3 then 'local history has one day'
                 when 4 then 'http 403 Forbidden' when 5 then 'source_challenge' else '' end as error_message,
               case when event_id % 13 < 6 then 'failed' when event_id % 13 = 6 then 'False' else 'success' end as status, cast(event_id % 3 as int) as tables_found
        from events""",
    "watchlist": """
        select c_custkey as seq, concat('HK', cast(c_custkey % 60 as string)) as code, c_name as name,
               concat(c_mktsegment, ';', case when c_custkey % 3 = 0 then 'Core' else 'core' end, '|', c_mktsegment) as group_text
        from customer""",
}


#: Views that sum a table into about as many rows, and the column (one of those they group by) by which its rows are dealt
#: first: left to itself, a task sums a whole split of the file in memory before the rows are dealt.
DEALT = {"held": ("lineitem", "l_suppkey")}


def _words(text: str) -> set[str]:
    return set(text.replace("\n", " ").replace("(", " ").replace(")", " ").split())


def view_sql(name: str) -> str:
    """A view as one clause of a `with`."""
    return f"{name} as ({VIEWS[name].strip()})"


def with_views(*names: str) -> str:
    """The `with` clauses of the named views and of what they need, to put before a select."""
    need: set[str] = set()

    def add(n: str) -> None:
        if n in VIEWS and n not in need:
            need.add(n)
            for other in VIEWS:
                if other != n and other in _words(VIEWS[n]):
                    add(other)

    for n in names:
        add(n)
    return "with " + ", ".join(view_sql(n) for n in VIEWS if n in need)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table of sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables of sf_dir; nothing is registered in the session."""
    text = VIEWS[name]
    words = _words(text)
    used = {n: view(spark, sf_dir, n) for n in VIEWS if n in words and n != name and list(VIEWS).index(n) < list(VIEWS).index(name)}
    used |= {t: load(spark, sf_dir, t) for t in TABLES if t in words}
    if name in DEALT:
        table, key = DEALT[name]
        used[table] = spread(used[table], key)
    for n in used:
        text = _reference(text, n)
    return spark.sql(text, **used)


def _reference(text: str, name: str) -> str:
    for before in ("from ", "join "):
        for after in (" ", "\n", ")"):
            text = text.replace(f"{before}{name}{after}", f"{before}{{{name}}}{after}")
        if text.endswith(f"{before}{name}"):
            text = text[: -len(name)] + f"{{{name}}}"
    return text
