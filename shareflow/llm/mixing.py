"""Mixing sources to target weights with DataFrame operations alone.

Every document gets a hash-random key. Within each source, documents are ordered by key; sums of sizes over key ranges
are accumulated once per range (not per row), so the prefix sum of a hot source is spread over KEY_RANGES groups. The
source's budget is cut exactly: whole epochs first, then documents in key order until the rest is used up; the document
at the cut gives only the words that are still missing. Words are counted in one pass over the texts, which is written.
Sources are thought to be named collections: their budgets are worked out over one row per source, in one task.

- size is the number of words (runs of non white space); null or empty text has size 0 and nothing is taken from it;
- null is a source of its own, after all others;
- the key is a digest of doc_id and text; ties are broken by doc_id and size; identical rows are interchangeable;
- a source of total size 0 has target 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shareflow.llm.common import WORD, text_or_empty, written

#: Ranges of the random key, by its first three hexadecimal digits.
KEY_RANGES = 4096
#: Most times that a document is used.
MAX_EPOCHS = 3


def targets(sources: DataFrame) -> DataFrame:
    """Budget of each source: its share of all words by weight, at most MAX_EPOCHS times its size.

    sources: source_key, source, source_size, one row per source. What capped sources can't use is shared among the
    rest by weight, until none is above its cap: with sources in order of cap per weight, the first whose share fits
    fixes the level for itself and all after it.
    """
    everything = Window.partitionBy()
    named = Window.orderBy(F.col("source").asc_nulls_last())
    before = Window.orderBy("cap_per_weight", "source_key").rowsBetween(Window.unboundedPreceding, -1)
    weighted = sources.withColumn("weight", (F.row_number().over(named) - 1) % 3 + 1)
    ranked = weighted.withColumn("cap", F.col("source_size") * MAX_EPOCHS).withColumn("cap_per_weight", F.col("cap").cast("double") / F.col("weight"))
    left = ranked.withColumn("words_left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn(
        "weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    share = F.col("words_left").cast("double") / F.col("weight_left")
    level = left.withColumn("share", F.when(share <= F.col("cap_per_weight"), share))
    first = Window.orderBy("cap_per_weight", "source_key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = level.withColumn("level", F.first("share", ignorenulls=True).over(first))
    return level.select("source_key", "source_size", "weight", F.least(F.col("cap").cast("double"), F.coalesce("level", F.lit(0.0)) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, taken: how many words of each document the mix takes."""
    sized = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")).alias("source_key"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text_or_empty()))).alias("key"),
    )
    sized = written(sized, "mix-sizes").withColumn("key_range", F.substring("key", 1, 3))
    ranges = sized.groupBy("source_key", "key_range").agg(F.first("source").alias("source"), F.sum("size").alias("range_size"))
    sources = ranges.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("range_size").alias("source_size"))
    earlier = Window.partitionBy("source_key").orderBy("key_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("before_range", F.coalesce(F.sum("range_size").over(earlier), F.lit(0))).drop("source", "range_size").join(targets(sources), "source_key")
    within = Window.partitionBy("source_key", "key_range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before_range") + F.coalesce(F.sum("size").over(within), F.lit(0))
    placed = sized.join(offsets, ["source_key", "key_range"]).withColumn("start", start)
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least("size", rest - F.col("start")))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


ORACLE = r"""
with sized as (
  select doc_id, source,
         cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
         coalesce('s' || source, 'null') as source_key,
         md5('mix:' || coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))) as key
  from documents),
sources as (
  select source_key, source, cast(sum(size) as bigint) as source_size from sized group by 1, 2),
weighted as (
  select *, cast((row_number() over (order by source asc nulls last) - 1) % 3 + 1 as bigint) as weight from sources),
ranked as (
  select *, source_size * 3 as cap, cast(source_size * 3 as double) / weight as cap_per_weight from weighted),
left_over as (
  select *,
    cast(sum(source_size) over () as double)
      - coalesce(sum(cap) over (order by cap_per_weight, source_key rows between unbounded preceding and 1 preceding), 0) as words_left,
    cast(sum(weight) over () as double)
      - coalesce(sum(weight) over (order by cap_per_weight, source_key rows between unbounded preceding and 1 preceding), 0) as weight_left
  from ranked),
level as (
  select words_left / weight_left as share from left_over where words_left / weight_left <= cap_per_weight
  order by cap_per_weight, source_key limit 1),
goal as (
  select source_key, source_size, least(cast(cap as double), coalesce((select share from level), 0.0) * weight) as target from ranked),
placed as (
  select s.doc_id, s.size, g.source_size, g.target,
    cast(floor(g.target) as bigint) as budget,
    coalesce(sum(s.size) over (partition by s.source_key order by s.key, s.doc_id, s.size rows between unbounded preceding and 1 preceding), 0) as start
  from sized s join goal g on s.source_key = g.source_key)
select doc_id, size, source_size, target,
  cast(case when source_size > 0 then (budget // source_size) * size + greatest(0, least(size, budget % source_size - start)) else 0 end as bigint) as taken
from placed
"""
