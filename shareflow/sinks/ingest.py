"""Idempotent writes to partitioned Parquet tables: the last write of a key wins, whatever the order of batches.

Parquet has no merge, so a batch rewrites the partitions it touches. The merged rows go to a staging table beside the
target first; the target's partitions are then overwritten from there, so no job reads what it overwrites.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shareflow.functions import scalars

SNAPSHOT_KEY = ["code", "date", "participant_id"]
PRICE_KEY = ["code", "date", "price_source"]


def last_written(rows: DataFrame, key: list[str], order: str = "fetched_at") -> DataFrame:
    """Of each key the row of the latest `order`; equal times are broken by the rows' content, so a rerun agrees."""
    newest = Window.partitionBy(*key).orderBy(F.desc(order), F.desc(F.xxhash64(*[c for c in rows.columns if c not in key])))
    return rows.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def _existing(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at path, or an empty one if nothing was written yet; other faults of reading it are errors."""
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], like.schema)


def written_beside(rows: DataFrame, path: str) -> DataFrame:
    """rows, written to a staging folder beside path and read again, so path itself can be overwritten."""
    staging = f"{path.rstrip('/')}_staging/{uuid.uuid4().hex}"
    rows.write.parquet(staging)
    return rows.sparkSession.read.schema(rows.schema).parquet(staging)


def _is_new(spark: SparkSession, path: str) -> bool:
    """Whether nothing was written to path yet."""
    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return True
    return False


def _overwrite(path: str, rows: DataFrame, partition: str) -> None:
    """Write the partitions that rows have; large ones by several tasks, small ones together by one."""
    rows.hint("rebalance", partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def upsert(path: str, incoming: DataFrame, key: list[str], partition: str = "date", order: str = "fetched_at") -> None:
    """Insert or replace rows by key; only partitions that incoming touches are read and written."""
    spark = incoming.sparkSession
    if _is_new(spark, path):  # nothing is read of what is written, so there is no need of a staging table
        return _overwrite(path, last_written(incoming, key, order), partition)
    touched = incoming.select(partition).distinct()
    old = _existing(spark, path, incoming).join(F.broadcast(touched) if touched.count() <= 10_000 else touched, partition, "left_semi")
    merged = last_written(old.select(incoming.columns).unionByName(incoming), key, order)
    _overwrite(path, written_beside(merged, path), partition)


def replace(path: str, rows: DataFrame, replaced: DataFrame, keys: list[str], partition: str = "date") -> None:
    """Put rows in the place of all rows whose keys are in replaced (distinct, partition among them); other rows stay.

    Only the partitions that replaced names are read and written, by way of a staging table.
    """
    spark = rows.sparkSession
    if _is_new(spark, path):
        return _overwrite(path, rows, partition)
    old = _existing(spark, path, rows).join(replaced.select(partition).distinct(), partition, "left_semi").join(replaced, keys, "left_anti")
    _overwrite(path, written_beside(old.select(rows.columns).unionByName(rows), path), partition)


def upsert_snapshots(path: str, incoming: DataFrame) -> None:
    upsert(path, incoming, SNAPSHOT_KEY)


def clean_prices(raw: DataFrame) -> DataFrame:
    """Price rows with numeric text: bad numbers become null, bad volume 0, rows without a date go."""
    number = lambda c: F.col(c) if dict(raw.dtypes)[c] != "string" else scalars.to_number(F.col(c))
    out = raw.withColumns({c: number(c).cast("double") for c in ("open", "high", "low", "close", "turnover", "vwap", "turnover_est") if c in raw.columns})
    day = F.col("date") if dict(raw.dtypes)["date"] == "date" else scalars.parse_date(F.col("date"))
    return out.withColumns({"volume": F.coalesce(number("volume"), F.lit(0)).cast("long"), "date": day}).filter("date is not null")


def upsert_prices(path: str, raw: DataFrame) -> int:
    """Clean and upsert prices; the number of rows of the batch."""
    rows = written_beside(clean_prices(raw), path)
    upsert(path, rows, PRICE_KEY)
    return rows.count()


def merged_meta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stock data after a batch: blank names and missing issued shares keep the old value, the as-of date is always replaced."""
    both = old.alias("o").join(new.alias("n"), "code", "full_outer")
    return both.select(
        "code",
        F.coalesce(scalars.blank_to_null(F.col("n.name")), F.col("o.name")).alias("name"),
        F.coalesce("n.issued_shares", "o.issued_shares").alias("issued_shares"),
        F.when(F.col("n.name").isNotNull() | F.col("n.issued_shares").isNotNull() | F.col("n.issued_shares_as_of").isNotNull(), F.col("n.issued_shares_as_of")).otherwise(F.col("o.issued_shares_as_of")).alias("issued_shares_as_of"),
    )


def daily_ingest(watchlist: DataFrame, landed: DataFrame, path: str, holdings: DataFrame | None = None, meta: DataFrame | None = None) -> DataFrame:
    """Upsert what has landed of listed codes and report each code: price rows, ok or the reason why not.

    Prices go to path/prices. holdings (snapshots, if given) go to path/snapshots, and meta is merged into path/stock_meta;
    then the report has snapshot_rows too. daily_totals() sums the report up.
    """
    of = lambda rows: rows.join(watchlist.select("code"), "code", "left_semi")
    counts = lambda rows, name: rows.groupBy("code").agg(F.count(F.lit(1)).alias(name))
    wanted = of(landed)
    upsert_prices(f"{path}/prices", wanted)
    report = watchlist.select("code").join(counts(wanted, "rows"), "code", "left")
    if holdings is not None:
        upsert_snapshots(f"{path}/snapshots", of(holdings))
        report = report.join(counts(of(holdings), "snapshot_rows"), "code", "left").withColumn("snapshot_rows", F.coalesce("snapshot_rows", F.lit(0)))
    if meta is not None:
        target = f"{path}/stock_meta"
        new = written_beside(merged_meta(_existing(meta.sparkSession, target, meta), of(meta)).select(meta.columns), target)
        new.write.mode("overwrite").parquet(target)
    error = F.when(F.col("rows").isNull(), "no prices landed")
    return report.withColumns({"ok": F.col("rows").isNotNull(), "error": error, "rows": F.coalesce("rows", F.lit(0))})


def daily_totals(report: DataFrame) -> DataFrame:
    """One row for a run: codes, and how many went well and failed."""
    return report.agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"))
