"""The registered queries of the corpus operators and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shareflow.llm import bpe, chat, cross_tokens, exact_dedup, licenses, line_dedup, lm, merkle, mixing, ngram_join, topk, toxicity, url_filter
from shareflow.llm.common import table


def op1_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path(vocabulary))
    return bpe.digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op2_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.filter("vec_id % 100 = 0"), vectors, 10)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = spark.sql(url_filter.CAPTURES_SQL.replace("from pages", "from {pages}"), pages=pages)
    return url_filter.url_filter(captures, url_filter.derived_entries(pages))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_split(table(spark, sf_dir, "documents"), exact_dedup.in_new_batch()).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.withColumnRenamed("rejected", "toxic")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_segments(rows))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"), {"text": merkle.lower_cased()})


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def vocabularies() -> cross_tokens.Vocabularies:
    return cross_tokens.Vocabularies(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


def op13_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_tokens.align(table(spark, sf_dir, "documents"), vocabularies())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_class_lm": op2_class_lm,
    "op3_ngram_join": op3_ngram_join,
    "op4_license_scan": op4_license_scan,
    "op5_exact_topk": op5_exact_topk,
    "op6_url_filter": op6_url_filter,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_mixing": op8_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_chat_format": op10_chat_format,
    "op11_merkle": op11_merkle,
    "op12_line_dedup": op12_line_dedup,
    "op13_cross_tokens": op13_cross_tokens,
}

ORACLES: dict[str, str] = {
    "op3_ngram_join": ngram_join.ORACLE,
    "op4_license_scan": licenses.oracle(),
    "op5_exact_topk": topk.ORACLE,
    "op6_url_filter": url_filter.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op10_chat_format": chat.ORACLE,
    "op11_merkle": merkle.ORACLE,
    "op12_line_dedup": line_dedup.ORACLE,
}
