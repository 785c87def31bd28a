"""Incremental ingest: landed files upserted as they come.

Late and repeated rows need no watermark: the key and fetched_at decide, and every micro-batch upsert is idempotent, so a
batch that is run again after a failure changes nothing. Tables that derive from snapshots are kept up to date batch by
batch: only the dates that a batch touches, and the dates after them, are worked out again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from shareflow.sinks.derived import refresh
from shareflow.sinks.ingest import PRICE_KEY, SNAPSHOT_KEY, clean_prices, upsert


def landed(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def start(
    source: DataFrame, target: str, checkpoint: str, key: list[str], clean: Callable[[DataFrame], DataFrame] | None = None, after: Callable[[DataFrame], None] | None = None
) -> StreamingQuery:
    """Upsert all that has landed and stop; run again for what lands later. after is called with each batch once it is in."""

    def batch(rows: DataFrame, _: int) -> None:
        rows = clean(rows) if clean else rows
        if not rows.isEmpty():
            upsert(target, rows, key)
            if after:
                after(rows)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_snapshots(source: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    return start(source, target, checkpoint, SNAPSHOT_KEY)


def ingest_prices(source: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    return start(source, target, checkpoint, PRICE_KEY, clean_prices)


def maintain(source: DataFrame, target: str, derived: str, checkpoint: str) -> StreamingQuery:
    """ingest_snapshots() that keeps derived/changes and derived/concentration as a full run over target would give them."""
    return start(source, target, checkpoint, SNAPSHOT_KEY, after=lambda rows: refresh(target, derived, rows.select("code", "date")))
