"""Exact deduplication against an immutable snapshot, screened by static binary fuse filters.

A snapshot is two written tables: exact buckets (one row per distinct digest, with the keeper and the number of rows)
and one filter per bucket; it can be written to a path of its own and read again by later batches. An incoming batch is
grouped by digest on its own first, so copies inside it collapse before they meet the snapshot. Its digests are screened
by the filter of their bucket; negatives are new without any look at the exact bucket, positives join it. Every group of
more than one row is then checked byte for byte: the least and greatest normalised text of the group must be the same.

Texts are read twice, once for their digests and once for the byte check, where only those of repeated digests are
compared. Those digests are broadcast up to FEW_REPEATED of them; beyond, texts are shuffled by digest. Results:

- null text counts as empty; empty texts are equal to one another;
- texts are equal when identical after each run of ASCII white space becomes one space;
- the row with the smallest doc_id stays; null doc_ids never win over others, and of a group with null ids only, all stay;
- rows that repeat a doc_id and text carry the same flags;
- an empty table gives an empty result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shareflow.llm import fuse
from shareflow.llm.common import SPACE, join_groups, shared_dir, text_or_empty, written

#: Digests that one bucket and its filter should hold.
BUCKET_ROWS = 200_000
#: Digests of repeated texts that the byte check broadcasts at most, 8 bytes each.
FEW_REPEATED = 1_000_000


class Snapshot(NamedTuple):
    exact: DataFrame
    filters: DataFrame
    buckets: int


def normalised():
    return F.regexp_replace(text_or_empty(), SPACE, " ")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of the normalised text, a row per row of docs."""
    return docs.select("doc_id", F.sha2(normalised(), 256).alias("digest"))


def grouped(hashed: DataFrame) -> DataFrame:
    return hashed.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n_rows"))


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")


def _keys(column: pa.ChunkedArray) -> np.ndarray:
    """The last 64 bits of each hexadecimal digest."""
    return np.array([int(x[-16:], 16) for x in column.to_pylist()], dtype=np.uint64)


def build_snapshot(hashed: DataFrame, path: str | None = None) -> Snapshot:
    """Write the exact buckets of a snapshot and their filters, to `path` or the shared folder; neither changes afterwards."""
    spark = hashed.sparkSession
    path = path or f"{shared_dir(spark)}/exact-dedup-{uuid.uuid4().hex}"
    grouped(hashed).write.parquet(f"{path}/exact")
    exact = spark.read.parquet(f"{path}/exact")
    buckets = max(1, -(-exact.count() // BUCKET_ROWS))

    def one(rows: pa.Table) -> pa.Table:
        return pa.table({"bucket": rows["bucket"][:1].cast(pa.int32()), "buckets": pa.array([buckets], pa.int32()), "filter": pa.array([fuse.build(_keys(rows["digest"]))], pa.binary())})

    filters = exact.select("digest", _bucket(buckets).alias("bucket")).groupBy("bucket").applyInArrow(one, "bucket int, buckets int, filter binary")
    filters.write.parquet(f"{path}/filters")
    return read_snapshot(spark, path)


def read_snapshot(spark: SparkSession, path: str) -> Snapshot:
    """A snapshot that build_snapshot has written to `path`."""
    filters = spark.read.parquet(f"{path}/filters")
    buckets = filters.agg(F.max("buckets")).first()[0]
    return Snapshot(spark.read.parquet(f"{path}/exact"), filters.drop("buckets"), buckets or 1)


def screen(groups: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The digests of groups that a filter lets through; all that are in the snapshot, and about 1 in 256 others."""

    def one(rows: pa.Table, filters: pa.Table) -> pa.Table:
        if not rows.num_rows or not filters.num_rows:
            return pa.table({"digest": pa.array([], pa.string())})
        hit = fuse.probe(filters["filter"][0].as_py(), _keys(rows["digest"]))
        return rows.select(["digest"]).filter(pa.array(hit))

    left = groups.select("digest", _bucket(snapshot.buckets).alias("bucket")).groupBy("bucket")
    return left.cogroup(snapshot.filters.groupBy("bucket")).applyInArrow(one, "digest string")


def same_bytes(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """The digests of repeated whose rows in docs all hold the same normalised bytes."""
    texts = docs.select(normalised().alias("norm")).withColumn("digest", F.sha2("norm", 256))
    if repeated.count() <= FEW_REPEATED:
        # a screen before any text is sorted or moved: a collision of the 64 bits lets a text through, no more
        texts = texts.join(F.broadcast(repeated.select(F.xxhash64("digest").alias("short"))), F.xxhash64("digest") == F.col("short"), "left_semi")
    checked = texts.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    return checked.join(repeated.select("digest"), "digest").filter("low = high").select("digest")


def _against(new: DataFrame, snapshot: Snapshot) -> DataFrame:
    """A row per distinct digest of either side: keep_id, n_rows and in_snapshot."""
    batch_groups = written(grouped(new), "exact-dedup-groups")
    positives = screen(batch_groups, snapshot)
    matched = positives.join(snapshot.exact.select("digest", F.col("keep_id").alias("old_id"), F.col("n_rows").alias("old_rows")), "digest")
    both = batch_groups.join(matched, "digest", "left").select(
        "digest",
        F.least("keep_id", "old_id").alias("keep_id"),
        (F.col("n_rows") + F.coalesce("old_rows", F.lit(0))).alias("n_rows"),
        F.col("old_rows").isNotNull().alias("in_snapshot"),
    )
    old_only = snapshot.exact.join(batch_groups.select("digest"), "digest", "left_anti").select("digest", "keep_id", "n_rows", F.lit(True).alias("in_snapshot"))
    return both.unionByName(old_only)


def dedup_split(docs: DataFrame, from_batch: Column) -> DataFrame:
    """exact_dedup() of one table, whose rows are in the batch where from_batch holds and in the earlier snapshot else."""
    hashed = written(docs.select("doc_id", F.sha2(normalised(), 256).alias("digest"), from_batch.alias("from_batch")), "exact-dedup-rows")
    snapshot = build_snapshot(hashed.filter("not from_batch"))
    groups = written(_against(hashed.filter("from_batch"), snapshot), "exact-dedup-all")
    checked = same_bytes(docs, groups.filter("n_rows > 1"))
    # a digest with differing texts would be a SHA-256 collision: stop rather than drop a text
    groups = groups.join(checked.withColumn("same", F.lit(True)), "digest", "left").withColumn(
        "group_size", F.when((F.col("n_rows") == 1) | F.col("same"), F.col("n_rows")).otherwise(F.raise_error(F.lit("different texts share a SHA-256 digest")).cast("long"))
    )
    return join_groups(hashed, groups.drop("same"), ["digest"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
        "in_snapshot",
        "from_batch",
    )


def exact_dedup(batch: DataFrame, earlier: DataFrame) -> DataFrame:
    """Groups of equal texts over a batch and the documents of an earlier snapshot.

    Returns a row per row of either: doc_id, keep_id, group_size, kept, text_sha256, in_snapshot (the text is in the
    snapshot), from_batch.
    """
    sides = [x.select("doc_id", "text", F.lit(new).alias("from_batch")) for x, new in ((earlier, False), (batch, True))]
    return dedup_split(sides[0].unionByName(sides[1]), F.col("from_batch"))


def in_new_batch() -> Column:
    """Splits one table into a batch and an earlier snapshot: rows go by a hash of their id, null ids to the batch."""
    return F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(2)) != 0, F.lit(True)) | F.col("doc_id").isNull()


def split_by_day(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The batch and the earlier snapshot of in_new_batch() as two frames."""
    return docs.filter(in_new_batch()), docs.filter(~in_new_batch())


ORACLE = r"""
with d as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id,
       min(doc_id) over (partition by text_sha256) as keep_id,
       count(*) over (partition by text_sha256) as group_size,
       doc_id is not distinct from min(doc_id) over (partition by text_sha256) as kept,
       text_sha256
from d
"""
