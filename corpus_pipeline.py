"""A corpus pipeline over documents: each stage is one operator of passagemill.llm, run on all that its predecessor kept.

The result has the masked texts of the documents taken, with mix_source, copies and n_tokens.
Stages keep extra columns; an empty table of documents gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from passagemill.llm import decontaminate, language_crf, mixing, secrets_scan, simhash_dedup
from passagemill.llm.shared import table, written


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without words (null and empty texts too), or with no language certain enough, go; those without a lang get the one identified."""
    return language_crf.keep_identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: the document with the least doc_id of each group stays; those without a doc_id all stay."""
    return simhash_dedup.dedup(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a test item go; an empty benchmark takes none."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def credentials(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: reported parts are masked in the text, and n_chars follows; the documents stay."""
    return secrets_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: the documents taken, with all their columns, for which source and how often.

    A document without a doc_id, tokens or a wanted source is not taken.
    """
    return mixing.mixed_documents(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify),
    ("simhash_dedup", near_copies),
    ("decontaminate", benchmark_leaks),
    ("secret_scan", credentials),
    ("mixing", mixture),
]

#: A conditional random field, SimHash blocks and a min-cost flow are not SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
