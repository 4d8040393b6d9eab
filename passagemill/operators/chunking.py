"""Chapters to overlapping passages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.functions.text import split_to_budget
from passagemill.options import TUNING


def chunk_chapters(chapters: DataFrame, budget: int = TUNING.chunk_chars, overlap: int = TUNING.overlap_chars) -> DataFrame:
    """(id, chapter, order, chunk_index, text) of chapters with title, order and text; a null text has no chunks."""
    cut = chapters.select(F.col("title").alias("chapter"), "order", F.posexplode(split_to_budget(F.col("text"), budget, overlap)).alias("chunk_index", "text"))
    return cut.select(F.concat_ws("-", F.col("order").cast("string"), F.col("chunk_index").cast("string")).alias("id"), "chapter", "order", "chunk_index", "text")


def first_chunks(chunks: DataFrame, n: int | None) -> DataFrame:
    """The first n chunks in reading order; all of them if n is none or not positive."""
    return chunks.orderBy("order", "chunk_index").limit(n) if n and n > 0 else chunks
