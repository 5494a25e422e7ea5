"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import send
from . import bpe, langid, media, mixing, near_dedup, phrase_dedup, quality, suffix_dedup, topk, url_filter
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op1(table(send(spark), sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.op2(table(send(spark), sf_dir, "documents"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.op3(table(send(spark), sf_dir, "embeddings"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op4(table(send(spark), sf_dir, "documents"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.op5(table(send(spark), sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op6(table(send(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op7(table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.op8(table(send(spark), sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup.op9(table(send(spark), sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.op10(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_media_columns, op3_exact_top_k, op4_byte_bpe, op5_suffix_array_dedup, op6_quality_classifier, op7_source_mixing, op8_minhash_near_dedup, op9_substring_dedup, op10_url_filter)}


def oracles() -> dict[str, str]:
    """DuckDB SQL of three; the others are tested against brute force, exact round trips or held-out accuracy."""
    return {
        "op3_exact_top_k": topk.ORACLE,
        "op7_source_mixing": mixing.ORACLE,
        "op10_url_filter": url_filter.oracle(*url_filter.train()),
    }
