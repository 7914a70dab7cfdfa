"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (bestposition, crf, decontaminate, htmlextract, linededup, mixing, orderminhash,
               qualityrules, sharding, suffixdedup, tokencount, turnrepair, urlfilter)
from .oracle import oracle_sql  # noqa: F401


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every copy goes here; the operator's default keeps the first.  The kept
    text is the last column."""
    return suffixdedup.dedup_substrings(table(spark, sf, "documents"), min_len=400, keep="none", keep_text=True)


def op2_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return qualityrules.judge(table(spark, sf, "documents"))


def op3_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return crf.score_documents(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op4_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf, "documents"))


def op5_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf, "documents"))


def op6_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op7_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return orderminhash.near_duplicates(table(spark, sf, "documents"))


def op8_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf, "documents"))


def op9_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf, "documents"), shards=16)


def op10_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf, "pages"))


def op11_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    return turnrepair.repair(turnrepair.damage(table(spark, sf, "conversations")))


def op12_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return bestposition.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=50)


def op13_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return htmlextract.main_text(table(spark, sf, "pages"))


QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_quality_rules, op3_quality_classifier, op4_mixing, op5_line_dedup,
    op6_decontamination, op7_minhash_near_dedup, op8_token_counts, op9_sharding, op10_url_filters,
    op11_conversation_repair, op12_ranked_search, op13_html_extraction)}
