"""Queries of this subpackage, each over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontaminate, embedding_dedup, language_crf, mixing, phrase_automata, ppm_score, secrets_scan, simhash_dedup, url_filter
from .shared import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.match_production(table(spark, sf_dir, "pages"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.groups(table(spark, sf_dir, "embeddings"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.groups(table(spark, sf_dir, "documents"))


def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_score.score(table(spark, sf_dir, "documents"))


def op8_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_automata.passages(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.scan(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_crf.identify(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_chat": op1_chat,
    "op2_url_filter": op2_url_filter,
    "op3_decontaminate": op3_decontaminate,
    "op4_embeddings": op4_embeddings,
    "op5_mixing": op5_mixing,
    "op6_simhash": op6_simhash,
    "op7_ppm": op7_ppm,
    "op8_phrases": op8_phrases,
    "op9_secrets": op9_secrets,
    "op10_language": op10_language,
}

ORACLE: dict[str, str] = {
    "op2_url_filter": url_filter.oracle(),
    "op9_secrets": secrets_scan.ORACLE,
}
