"""Chapters from web pages and from plain documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.functions.text import heading, html_to_text
from passagemill.operators.ordinal import with_ordinal
from passagemill.options import TUNING


def page_titles(pages: DataFrame) -> DataFrame:
    """(page_id, title): the given title if the table has one (an empty one counts), else heading, URL, id."""
    given = [F.col("title")] if "title" in pages.columns else []
    return pages.select("page_id", F.coalesce(*given, heading(F.col("html")), "url", F.col("page_id").cast("string")).alias("title"))


def chapters_from_pages(pages: DataFrame) -> DataFrame:
    """(title, href, order, text) of pages whose text is long enough; order counts the kept ones by page_id."""
    given = [F.col("title")] if "title" in pages.columns else []
    x = pages.select("page_id", F.coalesce(*given, heading(F.col("html")), "url", F.col("page_id").cast("string")).alias("title"), F.coalesce("url", F.lit("")).alias("href"), html_to_text(F.col("html")).alias("text"))
    return with_ordinal(x, ["page_id"], "order", f"length(text) >= {TUNING.least_page_chars}").select("title", "href", F.col("order").cast("bigint").alias("order"), "text")


def chapters_from_documents(documents: DataFrame) -> DataFrame:
    """Each document as a chapter, labelled by its language and source."""
    return documents.select(F.concat_ws("/", "lang", "source").alias("title"), F.lit("").alias("href"), F.col("doc_id").alias("order"), "text")
