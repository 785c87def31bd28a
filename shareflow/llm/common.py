"""What several corpus operators share: text patterns, table reads, tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space and its complement; the same text works for Java's, Python's and RE2's regexes.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words(column: Column) -> Column:
    """Array of the runs of characters that aren't ASCII white space."""
    return F.array_remove(F.split(column, SPACE), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or a temporary one where it is unset and all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shareflow-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, so that lost executors cost no recomputation.

    The folder is new for each call; whoever owns spark.checkpoint.dir clears it after the application.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key is hot if it has more than this share of all rows.
HOT_SHARE = 1e-3


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of rows with groups, which has a row per distinct key and its number of rows, n_rows (dropped).

    Hot keys are broadcast, so their rows stay where they are: at most 1 / HOT_SHARE keys can be hot, whatever the data.
    """
    groups = written(groups, "groups")
    least = (groups.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n")).first()["n"]) * HOT_SHARE
    hot = groups.filter(F.col("n_rows") > max(least, 1.0)).drop("n_rows")
    # left_anti keeps rows with a null key
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups.filter(F.col("n_rows") <= max(least, 1.0)).drop("n_rows"), keys, "left")
    return others.unionByName(rows.join(F.broadcast(hot), keys).select(*others.columns))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
