"""Registered queries over the driver's tables, each with the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shareflow.functions import scalars
from shareflow.functions.rules import CATEGORY_BY_ID, CATEGORY_BY_KEYWORD, ERROR_RULES, EVENT_TAGS, REASON_TAGS, RETRYABLE
from shareflow.operators import announcements, capital, concentration, flows, history, prices, quality, snapshots, tables
from shareflow.plans import reports
from shareflow.sinks.once import once
from shareflow.sources import pages
from shareflow.sources.views import load, view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str, *views: str) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        prefix = with_views(*views) if views else ""
        ORACLES[name] = prefix + (", " + sql.lstrip()[5:] if prefix and sql.lstrip().startswith("with ") else " " + sql)
        return query

    return add


#: Clauses that several oracles begin with.
RANKED = """with ranked as (
  select code, date, participant_id, participant_name, shares, bps,
    cast(row_number() over (partition by code, date order by shares desc, participant_id) as int) as rank,
    cast(sum(coalesce(bps, 0)) over (partition by code, date order by shares desc, participant_id rows unbounded preceding) as bigint) as cumulative_bps
  from snapshots)"""
PAIRS = """with pairs as (
  select code, date, lag(date) over (partition by code order by date) as previous_date from (select distinct code, date from snapshots))"""
SERIES = (
    RANKED
    + """, series as (
  select code, date, cast(coalesce(sum(bps) filter (rank <= 5), 0) as bigint) as top5_bps, cast(coalesce(sum(bps) filter (rank <= 10), 0) as bigint) as top10_bps,
    cast(coalesce(sum(bps), 0) as bigint) as total_bps
  from ranked group by all)"""
)
FEED = (
    SERIES
    + """, feed as (
  select code, date, case when total_bps <> 0 then top5_bps * 100.0::double / total_bps end as top5_pct, case when total_bps <> 0 then top10_bps * 100.0::double / total_bps end as top10_pct,
    cast(null as double) as top10_ncip_pct, total_bps / 10000.0::double as stake_pct from series)"""
)
CHANGES = (
    PAIRS
    + """, before as (select p.code, p.date, s.participant_id, s.participant_name, s.shares, s.bps from snapshots s join pairs p on s.code = p.code and s.date = p.previous_date),
after as (select s.code, s.date, s.participant_id, s.participant_name, s.shares, s.bps from snapshots s join pairs p on s.code = p.code and s.date = p.date where p.previous_date is not null),
changes as (
  select coalesce(b.code, a.code) as code, coalesce(b.date, a.date) as date, coalesce(b.participant_id, a.participant_id) as participant_id,
    coalesce(a.participant_name, b.participant_name) as participant_name, coalesce(a.shares, 0) - coalesce(b.shares, 0) as change_shares,
    a.bps - b.bps as change_bps, coalesce(a.shares, 0) as shares_after, a.bps as bps_after
  from before b full join after a on b.code = a.code and b.date = a.date and b.participant_id = a.participant_id)"""
)


def _snaps(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "snapshots")


def _changes(spark: SparkSession, d: str) -> DataFrame:
    """The changes of all codes; their dates are read apart, as there are few codes with many rows each."""
    snaps = _snaps(spark, d)
    return snapshots.consecutive_changes(snaps, snapshots.date_order(snaps))


def _like(column: str, phrases: list[str]) -> str:
    return "(" + " or ".join(f"contains({column}, '{p}')" for p in phrases) + ")"


CATEGORY_SQL = (
    "case "
    + " ".join(f"when participant_id = '{k}' then '{v}'" for k, v in CATEGORY_BY_ID.items())
    + " "
    + " ".join(f"when {_like('upper(participant_name)', words)} then '{c}'" for c, words in CATEGORY_BY_KEYWORD)
    + " when participant_id like 'C%' then 'bank' else 'unknown' end"
)
KINDS = f"kinds as (select participant_id, {CATEGORY_SQL} as category from (select participant_id, min(participant_name) as participant_name from snapshots group by 1))"


@register("holdings_ranked", RANKED + " select * from ranked", "snapshots")
def holdings_ranked(spark, d):
    return snapshots.holdings_ranked(_snaps(spark, d))


@register("cumulative_at", RANKED + " select code, date, max(cumulative_bps) filter (rank = 5) as cumulative_5_bps, max(cumulative_bps) filter (rank = 10) as cumulative_10_bps from ranked group by all", "snapshots")
def cumulative_at(spark, d):
    return snapshots.cumulative_at(snapshots.holdings_ranked(_snaps(spark, d)))


@register("snapshot_scan", "select code, date, participant_id, shares, bps from snapshots qualify date = max(date) over (partition by code)", "snapshots")
def snapshot_scan(spark, d):
    snaps = _snaps(spark, d)
    return snapshots.snapshots_at(snaps, snaps.groupBy("code").agg(F.max("date").alias("date"))).select("code", "date", "participant_id", "shares", "bps")


@register("date_pairs", PAIRS + " select * from pairs", "snapshots")
def date_pairs(spark, d):
    return snapshots.date_pairs(_snaps(spark, d))


@register("date_summary", PAIRS + " select code, max(date) as latest_date, arg_max(previous_date, date) as previous_date, count(*) as history_depth from pairs group by 1", "snapshots")
def date_summary(spark, d):
    return snapshots.date_summary(_snaps(spark, d))


@register(
    "concentration_series",
    SERIES + " select *, case when total_bps <> 0 then top5_bps * 100.0::double / total_bps end as top5_pct_of_ccass, case when total_bps <> 0 then top10_bps * 100.0::double / total_bps end as top10_pct_of_ccass from series",
    "snapshots",
)
def concentration_series(spark, d):
    return snapshots.concentration_series(_snaps(spark, d))


@register(
    "top_stakes",
    "with t as (select *, row_number() over (partition by code, date order by bps desc nulls last, participant_id) as r from snapshots) select code, date, cast(sum(bps) filter (r <= 5) as bigint) as top_bps from t group by all",
    "snapshots",
)
def top_stakes(spark, d):
    return snapshots.top_stakes(_snaps(spark, d))


@register("broker_counts", "select code, date, count(*) as participants from snapshots where regexp_matches(participant_id, '^[A-Ca-c][0-9]{5}$') group by all", "snapshots")
def broker_counts(spark, d):
    return snapshots.broker_counts(_snaps(spark, d))


@register(
    "snapshot_totals",
    "with t as (select code, date, cast(sum(shares) as bigint) as total_shares, cast(sum(coalesce(bps, 0)) as bigint) as total_bps from snapshots group by all) select *, total_shares - lag(total_shares) over (partition by code order by date) as change_shares from t",
    "snapshots",
)
def snapshot_totals(spark, d):
    return snapshots.snapshot_totals(_snaps(spark, d))


@register("consecutive_changes", CHANGES + " select * from changes", "snapshots")
def consecutive_changes(spark, d):
    return _changes(spark, d)


DIFF = (
    "with ends as (select code, min(date) as date_a, max(date) as date_b from snapshots group by 1), a as (select s.*, e.date_a, e.date_b from snapshots s join ends e on s.code = e.code and s.date = e.date_a),"
    " b as (select s.*, e.date_a, e.date_b from snapshots s join ends e on s.code = e.code and s.date = e.date_b),"
    " compared as (select coalesce(a.code, b.code) as code, coalesce(a.date_a, b.date_a) as date_a, coalesce(a.date_b, b.date_b) as date_b, coalesce(a.participant_id, b.participant_id) as participant_id,"
    " coalesce(b.participant_name, a.participant_name) as participant_name, coalesce(a.shares, 0) as shares_a, coalesce(b.shares, 0) as shares_b, coalesce(b.shares, 0) - coalesce(a.shares, 0) as change_shares,"
    " a.bps as bps_a, b.bps as bps_b, b.bps - a.bps as change_bps, case when a.shares is null then 'new' when b.shares is null then 'exited' when b.shares > a.shares then 'increased' when b.shares < a.shares then 'decreased' else 'unchanged' end as status"
    " from a full join b on a.code = b.code and a.participant_id = b.participant_id)"
)


def _ends(snaps: DataFrame) -> DataFrame:
    return snaps.groupBy("code").agg(F.min("date").alias("date_a"), F.max("date").alias("date_b"))


@register("snapshot_diff", DIFF + " select * from compared", "snapshots")
def snapshot_diff(spark, d):
    snaps = _snaps(spark, d)
    return snapshots.diff(snaps, _ends(snaps))


@register("diff_changed", DIFF + " select * from compared where change_shares <> 0", "snapshots")
def diff_changed(spark, d):
    snaps = _snaps(spark, d)
    return reports.diff_report(snaps, _ends(snaps))[0]


@register(
    "net_flow",
    DIFF + f", {KINDS} select code, date_a, date_b, coalesce(category, 'unknown') as category, cast(sum(change_shares) as bigint) as net_change_shares, count(*) as participants from compared left join kinds using (participant_id) group by all",
    "snapshots",
)
def net_flow(spark, d):
    snaps = _snaps(spark, d)
    return reports.diff_report(snaps, _ends(snaps))[1]


@register(
    "diff_summary",
    DIFF
    + ", r as (select *, row_number() over (partition by code order by bps_a desc nulls last, participant_id) as ra, row_number() over (partition by code order by bps_b desc nulls last, participant_id) as rb from compared)"
    " select code, date_a, date_b, count(*) filter (status <> 'new') as participants_a, count(*) filter (status <> 'exited') as participants_b, count(*) filter (status = 'new') as n_new, count(*) filter (status = 'exited') as n_exited,"
    " cast(sum(bps_a) filter (ra <= 5) as bigint) as top5_bps_a, cast(sum(bps_b) filter (rb <= 5) as bigint) as top5_bps_b from r group by all",
    "snapshots",
)
def diff_summary(spark, d):
    snaps = _snaps(spark, d)
    return reports.diff_report(snaps, _ends(snaps))[2]


@register("participant_categories", f"with {KINDS} select * from kinds", "snapshots")
def participant_categories(spark, d):
    return reports.categories_of(_snaps(spark, d)).select("participant_id", "category")


# concentration


@register(
    "concentration_dual_basis",
    FEED
    + " select *, top5_pct * stake_pct / 100 as top5_pct_of_issued, top10_pct * stake_pct / 100 as top10_pct_of_issued, coalesce(stake_pct > 100, false) or coalesce(top5_pct * stake_pct / 100 > 100, false) or coalesce(top10_pct * stake_pct / 100 > 100, false) as issued_may_be_stale from feed",
    "snapshots",
)
def concentration_dual_basis(spark, d):
    return reports.concentration_report(_snaps(spark, d))


@register(
    "five_observation_change",
    FEED
    + """, r as (select *, row_number() over (partition by code order by date desc) as r, count(*) over (partition by code) as n from feed)
select a.code, b.date as from_date, a.date as to_date, a.top5_pct - b.top5_pct as top5_pct_change, a.top10_pct - b.top10_pct as top10_pct_change, a.stake_pct - b.stake_pct as stake_pct_change
from r a join r b on a.code = b.code and a.r = 1 and b.r = least(5, b.n) where a.n >= 2""",
    "snapshots",
)
def five_observation_change(spark, d):
    return concentration.five_observation_change(reports.concentration_feed(_snaps(spark, d)))


@register(
    "concentration_bands",
    FEED
    + """, b as (select code, date, unnest([{'band': 'Top 5', 'band_order': 1, 'percent': top5_pct}, {'band': 'Top 6-10', 'band_order': 2, 'percent': top10_pct - top5_pct},
  {'band': 'NCIP', 'band_order': 3, 'percent': top10_pct - top10_pct}, {'band': 'Other CCASS', 'band_order': 4, 'percent': stake_pct - top10_pct}, {'band': 'Outside CCASS', 'band_order': 5, 'percent': 100 - stake_pct}]) as b
  from feed where top5_pct is not null)
select code, date, b.band as band, b.band_order as band_order, b.percent as percent from b where b.percent > 0""",
    "snapshots",
)
def concentration_bands(spark, d):
    return concentration.bands(reports.concentration_feed(_snaps(spark, d)))


@register(
    "concentration_lines",
    FEED
    + """, f as (select code, date, top5_pct, top10_pct, top10_pct + 1 as ncip from feed),
l as (select code, date, unnest([{'metric': 'top5_ncip', 'percent': top5_pct + greatest(ncip - top10_pct, 0)}, {'metric': 'top10_ncip', 'percent': ncip}]) as l from f),
k as (select code, date, l.metric as metric, l.percent as percent from l where l.percent between 0 and 100.5)
select code, date, metric, percent from k qualify date >= max(date) over (partition by code) - interval 365 day""",
    "snapshots",
)
def concentration_lines(spark, d):
    return concentration.lines(reports.concentration_feed(_snaps(spark, d)).withColumn("top10_ncip_pct", F.col("top10_pct") + 1))


@register(
    "concentration_out_of_range",
    FEED + ", f as (select code, date, top5_pct * 3 as v from feed) select code, date, 'top5_pct' as metric, v as value from f where v < 0 or v > 100",
    "snapshots",
)
def concentration_out_of_range(spark, d):
    return concentration.out_of_range(reports.concentration_feed(_snaps(spark, d)).withColumn("top5_pct", F.col("top5_pct") * 3))


@register(
    "stale_base_codes",
    FEED + " select code, bool_or(coalesce(stake_pct * 6 > 100, false) or coalesce(top5_pct * (stake_pct * 6) / 100 > 100, false) or coalesce(top10_pct * (stake_pct * 6) / 100 > 100, false)) as any_stale from feed group by 1",
    "snapshots",
)
def stale_base_codes(spark, d):
    return concentration.stale_codes(reports.concentration_feed(_snaps(spark, d)).withColumn("stake_pct", F.col("stake_pct") * 6))


@register(
    "concentration_fallback",
    FEED
    + """, kept as (select * from feed where code < '00010'), latest as (select code, max(date) as date from ranked group by 1),
made as (select r.code, r.date, max(cumulative_bps) filter (rank = 5) / 10000.0::double as top5_pct, max(cumulative_bps) filter (rank = 10) / 10000.0::double as top10_pct, cast(null as double) as top10_ncip_pct, max(cumulative_bps) / 10000.0::double as stake_pct
  from ranked r join latest l on r.code = l.code and r.date = l.date where r.code >= '00010' group by 1, 2)
select *, false as estimated from kept union all select *, true from made""",
    "snapshots",
)
def concentration_fallback(spark, d):
    snaps = _snaps(spark, d)
    return concentration.with_fallback(reports.concentration_feed(snaps).filter("code < '00010'"), snapshots.holdings_ranked(snaps))


# flows


def _big(spark: SparkSession, d: str) -> DataFrame:
    """Changes of stakes, in hundredths of a percent: the views' stakes are small, so a large move has two digits in this unit."""
    return _changes(spark, d).filter("change_bps is not null").withColumn("change_pct", F.col("change_bps") / 100.0)


BIG = CHANGES + ", big as (select *, change_bps / 100.0::double as change_pct from changes where change_bps is not null)"


@register(
    "transfer_pairs",
    BIG
    + """ select g.code, g.date, g.participant_name as gained_by, g.change_pct as gain_pct, l.participant_name as lost_by, l.change_pct as loss_pct from big g join big l on g.code = l.code and g.date = l.date
where g.change_pct >= 10 and l.change_pct <= -10 and abs(abs(g.change_pct) - abs(l.change_pct)) <= 0.05""",
    "snapshots",
)
def transfer_pairs(spark, d):
    return flows.transfer_pairs(_big(spark, d), 10.0, 0.05)


@register(
    "major_moves",
    CHANGES
    + """, m as (select *, case when change_shares > 0 then 'increase' else 'decrease' end as direction, cast(row_number() over (partition by code, date, sign(change_shares) order by abs(change_shares) desc, participant_id) as int) as move_rank from changes where change_shares <> 0)
select code, date, move_rank, participant_id, participant_name, change_shares, direction from m where move_rank <= 5""",
    "snapshots",
)
def major_moves(spark, d):
    return flows.major_moves(_changes(spark, d))


@register(
    "move_texts",
    CHANGES
    + """, m as (select *, row_number() over (partition by code, date, sign(change_shares) order by abs(change_shares) desc, participant_id) as move_rank from changes where change_shares <> 0)
select code, date, participant_name || ': ' || change_shares as text, participant_name as name, cast(change_shares as varchar) as change from m where move_rank <= 5""",
    "snapshots",
)
def move_texts(spark, d):
    moves = flows.move_text(flows.major_moves(_changes(spark, d)))
    return flows.split_move_text(moves.select("code", "date", "text"))


@register(
    "change_patterns",
    CHANGES
    + f""", s as (select code, date, cast(coalesce(sum(change_shares) filter (change_shares > 0), 0) as bigint) as gained, cast(coalesce(sum(-change_shares) filter (change_shares < 0), 0) as bigint) as lost,
  count(*) filter (change_shares > 0) as n_increased, count(*) filter (change_shares < 0) as n_decreased,
  count(*) filter (change_shares > 0 and coalesce(bps_after, 0) >= 10000) > 0 as large_increase,
  count(*) filter (change_shares > 0 and {_like("lower(participant_name)", flows.BROKER_WORDS)}) > 0 as broker_increase,
  count(*) filter (change_shares > 0 and {_like("lower(participant_name)", flows.CUSTODY_WORDS)}) > 0 as custody,
  coalesce(max(-change_shares) filter (change_shares < 0), 0) as largest_loss,
  array_to_string(list(participant_name order by change_shares desc, participant_id) filter (change_shares > 0 and coalesce(bps_after, 0) >= 10000)[1:3], ';') as large_names,
  array_to_string(list(participant_name order by change_shares desc, participant_id) filter (change_shares > 0 and {_like("lower(participant_name)", flows.BROKER_WORDS)})[1:5], ';') as broker_names,
  list(participant_name order by change_shares, participant_id) filter (change_shares < 0)[1] as seller from changes group by all)
select code, date, gained, lost, n_increased, n_decreased, large_increase, broker_increase, n_decreased > 0 and largest_loss * 2 >= lost as single_seller, n_increased >= 4 as spread_buying,
  case when gained > 0 and lost > 0 and abs(gained - lost) * 100 <= greatest(gained, lost) * 15 then 'yes' when custody and lost > 0 then 'possible' else 'no' end as transfer,
  coalesce(large_names, '') as large_names, coalesce(broker_names, '') as broker_names, case when n_decreased > 0 and largest_loss * 2 >= lost then seller end as seller_name from s""",
    "snapshots",
)
def change_patterns(spark, d):
    found = flows.change_patterns(_changes(spark, d))
    return found.withColumns({c: F.array_join(c, ";") for c in ("large_names", "broker_names")})


@register("largest_participant", RANKED + " select code, date, participant_id, trim(participant_name) as participant_name, bps from ranked qualify row_number() over (partition by code order by date desc, rank) = 1", "snapshots")
def largest_participant(spark, d):
    return flows.largest_participant(snapshots.holdings_ranked(_snaps(spark, d)))


@register("biggest_move", BIG + " select * exclude (change_bps, shares_after, bps_after) from big qualify row_number() over (partition by code order by abs(change_pct) desc, date, participant_id) = 1", "snapshots")
def biggest_move(spark, d):
    return flows.biggest_move(_big(spark, d), "change_pct", ["date", "participant_id"]).drop("change_bps", "shares_after", "bps_after")


PRINTED = BIG + ", printed as (select code, participant_name, change_pct, row_number() over (partition by code order by date, participant_id) as seq, case when row_number() over (partition by code, date order by participant_id) = 1 then date end as shown, date from big)"


def _printed(spark: SparkSession, d: str) -> DataFrame:
    """Big changes as a page prints them: the date stands only in the first row of each date."""
    # written once: the rows are read for their counts by date, too
    big = once(_big(spark, d).select("code", "date", "participant_id", "participant_name", "change_pct"), "big-changes")
    rows = tables.numbered_rows(big, ["code"], ["date"], ["participant_id"], "seq", "of_date")
    return rows.select("code", "participant_name", "change_pct", "seq", F.when(F.col("of_date") == 1, F.col("date")).alias("date"))


@register("filled_dates", PRINTED + " select code, participant_name, change_pct, seq::int as seq, date from printed", "snapshots")
def filled_dates(spark, d):
    return flows.filled_dates(once(_printed(spark, d), "printed"), tables.FILL_BLOCK)


@register(
    "name_to_id",
    PRINTED.replace("with pairs", RANKED + ", pairs", 1)
    + ", ids as (select code, participant_name, participant_id from ranked qualify row_number() over (partition by code, participant_name order by date desc, rank) = 1) select p.code, p.participant_name, p.change_pct, p.seq::int as seq, ids.participant_id from printed p left join ids on p.code = ids.code and p.participant_name = ids.participant_name",
    "snapshots",
)
def name_to_id(spark, d):
    return flows.with_participant_ids(_printed(spark, d).drop("date"), snapshots.holdings_ranked(_snaps(spark, d)))


# prices


@register(
    "latest_prices",
    "select *, cast(row_number() over (partition by code order by date desc, price_source) as int) as row_number, case when price_source = 'yahoo' and vwap is null and volume <> 0 then turnover_est / volume end as vwap_est from price_history qualify row_number <= 10",
    "price_history",
)
def latest_prices(spark, d):
    return prices.latest_prices(view(spark, d, "price_history"), 10)


CHART = """with chart as (
  select *, case when lag(close) over w <> 0 then (close - lag(close) over w) / lag(close) over w * 100 end as daily_change_pct, case when vwap <> 0 then (close - vwap) / vwap * 100 end as close_vs_vwap_pct,
    cast(coalesce(date - lag(date) over w, 1) as int) as gap_days
  from price_history window w as (partition by code order by date, price_source)),
seg as (select *, cast(sum(case when gap_days > 10 then 1 else 0 end) over (partition by code order by date, price_source rows unbounded preceding) as bigint) as segment from chart)"""


@register("price_chart", CHART + " select * from seg", "price_history")
def price_chart(spark, d):
    return prices.chart_frame(view(spark, d, "price_history"), None)


@register(
    "price_window",
    "select code, date, close from price_history qualify date >= max(date) over (partition by code) - interval 31 day",
    "price_history",
)
def price_window(spark, d):
    return prices.chart_frame(view(spark, d, "price_history"), tables.RANGES["1M"]).select("code", "date", "close")


@register("suspensions", CHART + " select code, cast(date - gap_days as date) as start_date, date as end_date from seg where gap_days > 1", "price_history")
def suspensions(spark, d):
    return prices.suspensions(prices.chart_frame(view(spark, d, "price_history"), None), 1)


@register("price_lines", CHART + " select code, date, segment, 'Close' as series, close as price from seg union all select code, date, segment, 'VWAP', vwap from seg where vwap is not null", "price_history")
def price_lines(spark, d):
    return prices.price_lines(prices.chart_frame(view(spark, d, "price_history"), None))


@register("bar_values", "select code, date, turnover / 1000000.0::double as millions from price_history where turnover is not null", "price_history")
def bar_values(spark, d):
    return prices.bar_values(view(spark, d, "price_history"))


@register(
    "price_stats",
    """with r as (select *, row_number() over w as n, count(turnover) over (partition by code order by date desc, price_source desc rows unbounded preceding) as known from price_history window w as (partition by code order by date desc, price_source desc)),
s as (select code, max(date) filter (n = 1) as date, max(close) filter (n = 1) as close, max(close) filter (n = 2) as previous_close, max(vwap) filter (n = 1) as vwap, max(volume) filter (n = 1) as volume, max(turnover) filter (n = 1) as turnover, sum(cast(floor(turnover * 100) as bigint)) filter (known <= 20) / (nullif(count(turnover) filter (known <= 20), 0) * 100.0::double) as mean_turnover from r group by 1)
select s.*, turnover / mean_turnover * 100 as turnover_vs_mean_pct, case when previous_close <> 0 then (close - previous_close) / previous_close * 100 end as daily_change_pct, case when vwap <> 0 then (close - vwap) / vwap * 100 end as close_vs_vwap_pct, case when issued_shares <> 0 then volume * 100.0::double / issued_shares end as turnover_rate_pct
from s left join stock_meta m on s.code = m.code""",
    "price_history",
    "stock_meta",
)
def price_stats(spark, d):
    return reports.price_report(view(spark, d, "price_history"), view(spark, d, "share_changes"), view(spark, d, "stock_meta")).stats.drop("issued_shares")


CAPITAL = """with cap as (select code, shares_million, cast(trunc(shares_million * 1000000) as bigint) as shares, change_date as as_of, reason from share_changes where change_date is not null and shares_million is not null qualify row_number() over (partition by code order by change_date desc, seq) = 1)"""


@register("latest_capital", CAPITAL + " select * from cap", "share_changes")
def latest_capital(spark, d):
    return capital.latest_capital(view(spark, d, "share_changes"))


@register(
    "price_report",
    CAPITAL
    + """, p as (select *, cast(row_number() over (partition by code order by date desc, price_source) as int) as row_number, case when price_source = 'yahoo' and vwap is null and volume <> 0 then turnover_est / volume end as vwap_est from price_history qualify row_number <= 20),
j as (select p.*, coalesce(cap.shares, m.issued_shares) as issued_shares, case when cap.shares is not null then cap.as_of else m.issued_shares_as_of end as issued_as_of, case when cap.shares is not null then 'share_changes' when m.issued_shares is not null then 'stock_meta' end as issued_source
  from p left join cap on p.code = cap.code left join stock_meta m on p.code = m.code)
select *, close * issued_shares as market_cap, case when close * issued_shares <> 0 then turnover * 100 / (close * issued_shares) end as turnover_to_cap_pct from j""",
    "price_history",
    "share_changes",
    "stock_meta",
)
def price_report(spark, d):
    return reports.price_report(view(spark, d, "price_history"), view(spark, d, "share_changes"), view(spark, d, "stock_meta")).prices


@register(
    "price_overlay",
    """with ends as (select code, min(date) as f, max(date) as l from price_history group by 1), c as (select code, 'mean' as label, 100.0::double as price from price_history group by 1)
select c.code, c.label, c.price, f as date from c join ends e on c.code = e.code union select c.code, c.label, c.price, l from c join ends e on c.code = e.code""",
    "price_history",
)
def price_overlay(spark, d):
    bars = view(spark, d, "price_history")
    return prices.overlay(bars, bars.select("code").distinct().select("code", F.lit("mean").alias("label"), F.lit(100.0).alias("price")))


@register("estimate_notes", "select code, 'Turnover is volume times close, an estimate' as note from price_history group by 1 having bool_or(price_source = 'yahoo') union all select code, 'VWAP follows from estimated turnover' from price_history group by 1 having bool_or(price_source = 'yahoo' and vwap is null)", "price_history")
def estimate_notes(spark, d):
    return quality.estimate_notes(view(spark, d, "price_history"))


# histories


SAMPLED = """with d as (select distinct code, date from snapshots), r as (select code, date from d qualify date >= max(date) over (partition by code) - interval 365 day),
n as (select code, date, row_number() over (partition by code order by date) - 1 as pos, count(*) over (partition by code) as n from r),
sampled as (select code, date from n where n <= 3 or pos in (cast(round_even(0 * (n - 1) / 2.0::double, 0) as int), cast(round_even(1 * (n - 1) / 2.0::double, 0) as int), cast(round_even(2 * (n - 1) / 2.0::double, 0) as int)))"""


@register("sampled_dates", SAMPLED + " select * from sampled", "snapshots")
def sampled_dates(spark, d):
    return history.sampled_dates(_snaps(spark, d), 3)


TOP = RANKED.replace("with ", "", 1) + """, latest as (select code, max(date) as date from ranked group by 1),
top as (select r.code, r.participant_id, r.participant_name, r.participant_name || ' (' || r.participant_id || ')' as label, cast(row_number() over (partition by r.code order by r.rank) as int) as "order" from ranked r join latest l on r.code = l.code and r.date = l.date where r.rank <= 10)"""


@register("top_participants", "with " + TOP + " select * from top", "snapshots")
def top_participants(spark, d):
    return history.top_participants(snapshots.holdings_ranked(_snaps(spark, d)))


@register(
    "participant_history",
    SAMPLED + ", " + TOP + ' select t.code, s.date, t."order", t.participant_id, t.label, h.shares, coalesce(h.bps, 0) as bps from top t join sampled s on t.code = s.code left join snapshots h on h.code = t.code and h.date = s.date and h.participant_id = t.participant_id',
    "snapshots",
)
def participant_history(spark, d):
    return reports.participant_history(_snaps(spark, d), 10, 3)


@register(
    "aligned_prices",
    "with b as (select lpad(cast(user_id as varchar), 5, '0') as code, min(cast(ts as date)) as lo, max(cast(ts as date)) as hi from events where event_type = 'purchase' group by 1) select p.code, p.date, p.close from price_history p join b on p.code = b.code where p.date between lo and hi",
    "price_history",
)
def aligned_prices(spark, d):
    # a code's prices from its first to its last purchase
    bought = load(spark, d, "events").filter("event_type = 'purchase'")
    bounds = bought.select(F.lpad(F.col("user_id").cast("string"), 5, "0").alias("code"), F.to_date("ts").alias("date"))
    return tables.within_bounds(view(spark, d, "price_history").select("code", "date", "close"), bounds, ["code"], "date")


# capital and announcements

TAGS_SQL = "list_filter([" + ", ".join(f"case when {_like('r', needles)} then '{tag}' end" for tag, needles in REASON_TAGS) + "], lambda x: x is not null)"


@register(
    "share_changes_tagged",
    f"with t as (select *, coalesce(reason, '') as r from share_changes) select code, seq, change_date, shares_million, reason, cast(trunc(shares_million * 1000000) as bigint) as shares_approx, array_to_string({TAGS_SQL}, ',') as tags, cast(row_number() over (partition by code order by seq) as int) as row_no from t qualify row_no <= 30",
    "share_changes",
)
def share_changes_tagged(spark, d):
    rows = reports.capital_report(view(spark, d, "share_changes"), view(spark, d, "buybacks"))[1]
    return rows.withColumn("tags", F.array_join("reason_tags", ",")).drop("reason_tags")


@register("buybacks_first", "select *, cast(row_number() over (partition by code order by seq) as int) as row_no from buybacks qualify row_no <= 20", "buybacks")
def buybacks_first(spark, d):
    return reports.capital_report(view(spark, d, "share_changes"), view(spark, d, "buybacks"))[2]


# the patterns run over lower-case text; \b and \w are ASCII in DuckDB, and the words next to them are
EVENTS_SQL = "list_sort(list_distinct(list_filter([" + ", ".join(f"case when regexp_matches(t, '{p}') then '{tag}' end" for tag, p in EVENT_TAGS) + "], lambda x: x is not null)))"


@register(
    "announcement_tags",
    f"with a as (select *, lower(coalesce(category, '') || ' ' || coalesce(title, '')) as t from announcements) select news_id, code, publish_date, array_to_string({EVENTS_SQL}, ',') as tags from a where len({EVENTS_SQL}) > 0",
    "announcements",
)
def announcement_tags(spark, d):
    return announcements.timeline(view(spark, d, "announcements")).select("news_id", "code", "publish_date", F.array_join("event_tags", ",").alias("tags"))


@register("announcement_period", "select news_id, code, publish_date from announcements where publish_date >= date '2026-01-01' - interval 730 day", "announcements")
def announcement_period(spark, d):
    return announcements.in_period(view(spark, d, "announcements"), "2026-01-01", 2).select("news_id", "code", "publish_date")


@register(
    "tag_summary",
    f"with a as (select *, lower(coalesce(category, '') || ' ' || coalesce(title, '')) as t from announcements), g as (select code, {EVENTS_SQL} as tags from a) select code, count(*) as announcements, count(*) filter (len(tags) > 0) as tagged, array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') as tags from g group by 1",
    "announcements",
)
def tag_summary(spark, d):
    return announcements.tag_summary(view(spark, d, "announcements"))


# fetch log and watchlist

FAILED = "(lower(coalesce(status, '')) in ('failed', 'false') or coalesce(error_message, '') <> '')"
GAP = f"(lower(trim(section)) = 'big changes' and {_like('lower(coalesce(error_message, chr(32)))', ['local history', 'not enough sdw snapshots', 'mirror historical data', 'big changes require'])})"
CODE_SQL = "case " + " ".join(f"when {_like('lower(error_message)', phrases)} then '{c}'" for c, phrases in ERROR_RULES) + " else 'PARSE_ERROR' end"
ERRORS = f"""with errors as (select code, seq, {CODE_SQL} as error_code, section || ': ' || coalesce(nullif(error_message, ''), lower(status)) as message from fetch_log where {FAILED} and not {GAP}),
known as (select *, error_code in ({", ".join(f"'{x}'" for x in RETRYABLE)}) as retry from errors)"""


@register("structured_errors", ERRORS + " select * from known", "fetch_log")
def structured_errors(spark, d):
    return quality.structured_errors(view(spark, d, "fetch_log"))


@register("distinct_errors", ERRORS + " select * from known qualify row_number() over (partition by code, error_code, message order by seq) = 1", "fetch_log")
def distinct_errors(spark, d):
    return quality.distinct_errors(quality.structured_errors(view(spark, d, "fetch_log")))


WARNINGS = f"""with w as (select code, seq, case when {GAP} then 'Big Changes unavailable: too few days of history, so the timing of large moves is not known.' else section || ' failed or incomplete: ' || coalesce(nullif(error_message, ''), lower(status)) end as warning from fetch_log where {FAILED})"""


@register("failure_warnings", WARNINGS + " select * from w", "fetch_log")
def failure_warnings(spark, d):
    return quality.failure_warnings(view(spark, d, "fetch_log"))


@register(
    "quality_report",
    WARNINGS
    + """, n as (select code, 1099511627776 as seq, 'Turnover is volume times close, an estimate' as warning from price_history group by 1 having bool_or(price_source = 'yahoo') union all select code, 1099511627776, 'VWAP follows from estimated turnover' from price_history group by 1 having bool_or(price_source = 'yahoo' and vwap is null)),
u as (select * from w union all select * from n) select * from u qualify row_number() over (partition by code, warning order by seq) = 1""",
    "fetch_log",
    "price_history",
)
def quality_report(spark, d):
    return reports.quality_report(view(spark, d, "fetch_log"), view(spark, d, "price_history"))


@register("primary_failure", f"select code, seq, section, status, error_message from fetch_log where {FAILED} qualify row_number() over (partition by code order by seq) = 1", "fetch_log")
def primary_failure(spark, d):
    return quality.primary_failure(view(spark, d, "fetch_log"))


@register("payload_status", ERRORS + ", f as (select * from known qualify row_number() over (partition by code order by seq) = 1) select c.code, error_code, message as hint, error_code is null as ok from (select distinct code from fetch_log) c left join f on c.code = f.code", "fetch_log")
def payload_status(spark, d):
    return quality.payload_status(view(spark, d, "fetch_log"))


@register(
    "fetch_summary",
    """with s as (select unnest(['Holdings', 'Changes', 'Big Changes', 'Concentration', 'Price History']) as section, unnest(range(0, 5)) as section_no), g as (select * from (select distinct code from fetch_log) cross join s),
l as (select * from fetch_log qualify row_number() over (partition by code, section order by seq desc) = 1), m as (select code, section, max(fetched_on) as latest_date from fetch_log group by all)
select g.code, cast(g.section_no as int) as section_no, g.section, coalesce(l.status, 'missing') as status, coalesce(l.tables_found, 0) as tables_found, m.latest_date, nullif(l.error_message, '') as error
from g left join l on g.code = l.code and g.section = l.section left join m on g.code = m.code and g.section = m.section""",
    "fetch_log",
)
def fetch_summary(spark, d):
    return quality.fetch_summary(view(spark, d, "fetch_log"))


@register("run_totals", f"select fetched_on, count(*) as total, count(*) filter (not {FAILED}) as ok, count(*) filter ({FAILED}) as failed from fetch_log group by 1", "fetch_log")
def run_totals(spark, d):
    return quality.run_totals(view(spark, d, "fetch_log"))


@register("section_counts", "select code, section, count(*) as total_rows, least(count(*), 20) as returned_rows, count(*) > 20 as truncated from fetch_log group by all", "fetch_log")
def section_counts(spark, d):
    return tables.section_counts(view(spark, d, "fetch_log"), ["code", "section"], 20)


WATCH = """with w as (select seq, case when length(regexp_replace(code, '[^0-9]', '', 'g')) >= 5 then regexp_replace(code, '[^0-9]', '', 'g') else lpad(regexp_replace(code, '[^0-9]', '', 'g'), 5, '0') end as code, name,
  list_filter(list_transform(regexp_split_to_array(group_text, '[;|]'), lambda x: lower(trim(x))), lambda x: x <> '') as g from watchlist),
u as (select seq, code, name, list_filter(g, lambda x, i: list_position(g, x) = i) as g from w)"""


@register("watchlist", WATCH + " select seq, code, name, array_to_string(g, ';') as groups from u qualify row_number() over (partition by code order by seq) = 1", "watchlist")
def watchlist(spark, d):
    rows = view(spark, d, "watchlist").select("seq", scalars.stock_code(F.col("code")).alias("code"), "name", scalars.groups(F.col("group_text")).alias("groups"))
    return tables.first_rows(rows, ["code"], [F.asc("seq")]).withColumn("groups", F.array_join("groups", ";"))


@register("watchlist_group", WATCH + " select seq, code from u where list_contains(g, 'core')", "watchlist")
def watchlist_group(spark, d):
    rows = view(spark, d, "watchlist").select("seq", scalars.stock_code(F.col("code")).alias("code"), scalars.groups(F.col("group_text")).alias("groups"))
    return rows.filter(F.array_contains("groups", "core")).select("seq", "code")


@register("requested_codes", WATCH + ", f as (select seq, code from u qualify row_number() over (partition by code order by seq) = 1), n as (select code, seq, cast(row_number() over (order by seq) as int) as n from f) select code, seq, case when n <= 20 then n end as number, n > 20 as over from n", "watchlist")
def requested_codes(spark, d):
    return reports.requested_codes(view(spark, d, "watchlist").select("seq", "code"))


# composites


SCREEN = (
    SERIES
    + ", "
    + CHANGES.replace("with ", "", 1)
    + f""", {KINDS}, latest as (select code, max(date) as date, arg_max(previous_date, date) as p, count(*) as history_depth from pairs group by 1),
holder as (select r.code, r.participant_id as largest_id, trim(r.participant_name) as largest_name, k.category as largest_category, r.bps as largest_bps from ranked r join latest l on r.code = l.code and r.date = l.date left join kinds k on k.participant_id = r.participant_id where r.rank = 1),
mover as (select code, participant_id as mover_id, change_shares as mover_change, date as mover_date from changes qualify row_number() over (partition by code order by abs(change_shares) desc, date, participant_id) = 1),
wanted as (select c_custkey as seq, lpad(cast(c_custkey % 60 as varchar), 5, '0') as code, cast(c_custkey % 60 as varchar) as requested from customer)
select w.*, m.name, s.date, s.top5_bps, s.top10_bps, s.total_bps, l.history_depth, h.* exclude (code), v.* exclude (code), case when s.date is null then 'no snapshot of this code' end as error
from wanted w left join latest l on w.code = l.code left join stock_meta m on m.code = w.code left join series s on s.code = w.code and s.date = l.date left join holder h on h.code = w.code left join mover v on v.code = w.code"""
)


def _wanted(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").select(F.col("c_custkey").alias("seq"), (F.col("c_custkey") % 60).cast("string").alias("code"))


@register("screen", SCREEN, "snapshots", "stock_meta")
def screen(spark, d):
    return reports.screen(_snaps(spark, d), view(spark, d, "stock_meta"), _wanted(spark, d)).drop("top5_pct_of_ccass", "top10_pct_of_ccass")


@register(
    "participant_search",
    RANKED
    + """, latest as (select code, max(date) as date from ranked group by 1), mine as (select r.* from ranked r join latest l on r.code = l.code and r.date = l.date where r.participant_id = 'B00012'),
wanted as (select distinct lpad(cast(c_custkey % 60 as varchar), 5, '0') as code from customer)
select w.code, m.* exclude (code), m.participant_id is not null as found from wanted w left join mine m on w.code = m.code""",
    "snapshots",
)
def participant_search(spark, d):
    return reports.participant_search(_snaps(spark, d), "participant id: b00012", _wanted(spark, d))


@register(
    "report_holdings",
    RANKED + f", {KINDS}, latest as (select code, max(date) as date from ranked group by 1) select r.*, k.category from ranked r join latest l on r.code = l.code and r.date = l.date left join kinds k on k.participant_id = r.participant_id where rank <= 15",
    "snapshots",
)
def report_holdings(spark, d):
    return reports.stock_report(_snaps(spark, d)).holdings


@register(
    "report_changes",
    CHANGES
    + f""", {KINDS}, latest as (select code, max(date) as date from pairs group by 1), c as (select c.*, cast(row_number() over (partition by c.code order by abs(change_shares) desc, c.participant_id) as int) as row_no from changes c join latest l on c.code = l.code and c.date = l.date)
select c.*, k.category from c left join kinds k on k.participant_id = c.participant_id where row_no <= 20""",
    "snapshots",
)
def report_changes(spark, d):
    return reports.stock_report(_snaps(spark, d)).changes


# scalar functions over whole tables


@register("page_links", """select page_id, cast(i - 1 as int) as link_no, links[i] as href from (select page_id, links, unnest(range(1, len(links) + 1)) as i from (select page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1) as links from pages))""".replace("\\\\", "\\"))
def page_links(spark, d):
    return pages.outbound_links(load(spark, d, "pages"), ["page_id"])


@register("page_urls", "select page_id, case when regexp_matches(url, '^https://[^/@:]+([/?#]|$)') and regexp_extract(url, '^https?://([^/?#]*)', 1) in (select host from (select regexp_extract(url, '^https?://([^/?#]*)', 1) as host, count(*) as n from pages group by 1) where host <> '' order by n desc, host limit 5) then regexp_replace(url, '#.*$', '') end as allowed from pages")
def page_urls(spark, d):
    rows = load(spark, d, "pages").select("page_id", "url")
    host = F.regexp_extract("url", "^https?://([^/?#]*)", 1)
    # the allow-list is the five hosts with the most pages
    first = rows.filter(host != "").groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "host").limit(5)
    return rows.select("page_id", scalars.allowed_url(F.col("url"), [r["host"] for r in first.collect()]).alias("allowed"))


@register(
    "text_quality",
    "select doc_id, 10 * (length(text) - length(regexp_replace(text, '[一-鿿]', '', 'g'))) + length(text) - length(regexp_replace(text, '[A-Za-z0-9]', '', 'g')) - 20 * (length(text) - length(regexp_replace(text, '\ufffd', '', 'g'))) as score, length(text) as chars_total, least(length(text), 500) as chars_returned, length(text) > 500 as truncated, substr(text, 1, 500) as head from documents",
)
def text_quality(spark, d):
    docs = load(spark, d, "documents")
    cut = scalars.truncated(F.col("text"), 500)
    return docs.select("doc_id", scalars.text_quality(F.col("text"))["score"].alias("score"), *(cut[x].alias(x) for x in ("chars_total", "chars_returned", "truncated", "head")))


@register(
    "code_forms",
    "select c_custkey, case when length(k) >= 5 then k else lpad(k, 5, '0') end as code, (case when length(k) >= 4 then k else lpad(k, 4, '0') end) || '.HK' as ticker, 'HK' || (case when length(k) >= 4 then k else lpad(k, 4, '0') end) as slug, length(k) between 4 and 8 as issue_like from (select c_custkey, cast(c_custkey as varchar) as k from customer)",
)
def code_forms(spark, d):
    k = F.col("c_custkey").cast("string")
    rows = load(spark, d, "customer")
    return rows.select("c_custkey", scalars.stock_code(k).alias("code"), scalars.ticker(k).alias("ticker"), scalars.slug(k).alias("slug"), scalars.looks_like_issue_id(k).alias("issue_like"))


@register("fresh_codes", "select distinct code from price_history where date = (select max(date) from price_history)", "price_history")
def fresh_codes(spark, d):
    bars = view(spark, d, "price_history")
    return quality.fresh_codes(bars, str(bars.agg(F.max("date")).first()[0]))


@register(
    "event_days",
    "select code, count(distinct fetched_on) as fetched_days, max(fetched_on) as data_as_of from fetch_log group by 1",
    "fetch_log",
)
def event_days(spark, d):
    return quality.fetched_days(view(spark, d, "fetch_log"))


@register("latest_lines", CHART + ", l as (select code, 'Close' as series, date, close as price from seg union all select code, 'VWAP', date, vwap from seg where vwap is not null) select * from l qualify row_number() over (partition by code, series order by date desc) = 1", "price_history")
def latest_lines(spark, d):
    rows = prices.price_lines(prices.chart_frame(view(spark, d, "price_history"), None)).drop("segment")
    return tables.last_rows(rows, ["code", "series"], "date")


@register(
    "capital_summary",
    CAPITAL + ", b as (select code, count(*) as n_buybacks, max(buyback_date) as last_buyback from buybacks group by 1) select cap.*, coalesce(n_buybacks, 0) as n_buybacks, last_buyback from cap left join b on cap.code = b.code",
    "share_changes",
    "buybacks",
)
def capital_summary(spark, d):
    bought = view(spark, d, "buybacks").groupBy("code").agg(F.count(F.lit(1)).alias("n_buybacks"), F.max("buyback_date").alias("last_buyback"))
    return capital.latest_capital(view(spark, d, "share_changes")).join(bought, "code", "left").withColumn("n_buybacks", F.coalesce("n_buybacks", F.lit(0)))


from shareflow.plans import source_queries  # noqa: E402, F401  (registers its queries)
