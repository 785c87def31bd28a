"""The corpus pipeline: documents in, token ids out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next one's docs.
All but the last return the columns of documents. Documents are told apart by doc_id and text: rows that repeat both are
one document, a null doc_id is an id like any other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shareflow.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from shareflow.llm.common import table, text_or_empty, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def row_key() -> Column:
    """What tells documents apart, doc_id and text, as one string; in order of doc_id, null last, then of the text's digest."""
    # with the sign bit flipped, hexadecimal digits are in the order of the numbers
    number = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return F.concat(F.coalesce(F.concat(F.lit("0"), number), F.lit("1")), F.lit(":"), F.sha2(text_or_empty(), 256))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't reject."""
    models = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, models, keep=COLUMNS).filter(~F.col("rejected")).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id."""
    kept = exact_dedup.dedup_split(docs, exact_dedup.in_new_batch()).filter("kept").select(F.col("doc_id").alias("id"), "text_sha256")
    hashed = docs.withColumn("digest", F.sha2(exact_dedup.normalised(), 256))
    left = hashed.join(kept, hashed["doc_id"].eqNullSafe(kept["id"]) & (hashed["digest"] == kept["text_sha256"]), "left_semi")
    return left.dropDuplicates(["doc_id", "digest"]).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the document with the smallest doc_id, then with the smallest digest."""
    keyed = docs.withColumn("row_key", row_key())
    joined = ngram_join.ngram_join(keyed.select(F.col("row_key").alias("doc_id"), "text"))
    first = joined.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("row_key"))
    return keyed.join(first, "row_key", "left_semi").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, whole: the one at a source's cut by whether half of it is taken.

    Null, empty and blank texts have no words, so the mix never takes them: they end here.
    """
    keyed = docs.withColumn("row_key", row_key()).dropDuplicates(["row_key"])
    taken = mixing.mix(keyed.select(F.col("row_key").alias("doc_id"), "text", "source"))
    taken = taken.filter("size > 0").select(F.col("doc_id").alias("row_key"), F.floor((F.col("taken") + F.col("size") / 2) / F.col("size")).cast("int").alias("copies"))
    return keyed.join(taken.filter("copies > 0"), "row_key").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids, a row per row of docs."""
    ranks = bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]

#: SQL can't express the classifier of the first stage: tests/llm/test_pipeline.py holds every stage and run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; between two stages the documents are a written table."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, written(docs, f"pipeline-{k}") if k else docs, sf_dir)
    return docs
