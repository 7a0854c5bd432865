"""One query per operator, over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (alignment, bpe_automaton, bwt_dedup, hard_negatives, html_text, language_id, near_dedup,
               packing, quality_rules, substring_dedup, token_files, url_filter, winnowing)
from .common import documents, ship_package
from .oracles import SQL  # noqa: F401

#: End-of-document id that op4 appends.
END_ID = 2

#: The rules of op13.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
             ("com/fr/", "allow"), ("com/de/", "block")]


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), n=2, percent=80)


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edited_and_next(documents(spark, sf_dir)).select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        winnowing.as_string(F.col("chosen")).alias("fingerprint"),
        winnowing.as_string(F.col("edited_chosen")).alias("edited_fingerprint"),
        "near_edited", "near_next")


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_automaton.round_trip(documents(spark, sf_dir),
                                   public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    folder = token_files.new_folder(docs)
    token_files.write(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID, folder)
    return token_files.read(spark, folder).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.repeated(documents(spark, sf_dir).select("doc_id", "text"), size=50)
    return out.select("doc_id", F.col("_n_words").alias("n_words"),
                      F.col("_n_removed").alias("n_removed"),
                      F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(documents(spark, sf_dir))


def op7_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bwt_dedup.repeated(documents(spark, sf_dir).select("doc_id", "text"), size=50)
    return out.select("doc_id", F.col("_n_bytes").alias("n_bytes"),
                      F.col("_n_removed").alias("n_removed"), F.col("_n_spans").alias("n_spans"),
                      F.sha2(F.col("_kept"), 256).alias("kept_sha256"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return html_text.extract(pages).withColumn("n_chars", F.char_length("text").cast("bigint"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"),
                              public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return alignment.with_counts(aligned.withColumn("groups_sha256", digest).drop("groups")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
        .alias("label"), "embedding")
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0)


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES).drop("score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_winnowing": op2_winnowing,
    "op3_bpe_round_trip": op3_bpe_round_trip,
    "op4_token_files": op4_token_files,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_bwt_dedup": op7_bwt_dedup,
    "op8_html_text": op8_html_text,
    "op9_language_id": op9_language_id,
    "op10_packing": op10_packing,
    "op11_token_alignment": op11_token_alignment,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_url_filter": op13_url_filter,
    "pipeline": pipeline,
}

