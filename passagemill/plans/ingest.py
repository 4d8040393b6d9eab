"""From chapters to the stored passage table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.operators.chunking import chunk_chapters, first_chunks
from passagemill.sources import store
from passagemill.sources.providers import Providers


def embed_chunks(chunks: DataFrame, providers: Providers) -> DataFrame:
    """chunks with vector; rows are handed to the model by length within each partition, so that batches pad little."""
    return providers.embed_documents(chunks.sortWithinPartitions(F.length("text")))


def ingest(chapters: DataFrame, path: str, providers: Providers | None = None, max_chunks: int | None = None) -> dict[str, object]:
    chunks = first_chunks(chunk_chapters(chapters), max_chunks)
    store.recreate(embed_chunks(chunks, providers or Providers()), path)
    return store.info(chapters.sparkSession, path)
