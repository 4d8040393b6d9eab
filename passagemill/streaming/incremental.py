"""Beyond the batch rebuild: passages kept up to date from a stream of documents, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from passagemill.operators.chunking import chunk_chapters
from passagemill.sources.pages import chapters_from_documents


def chunk_stream(documents: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the passages of every new document; a batch that is replayed writes its own folder again, so none is doubled."""

    def write(batch: DataFrame, number: int) -> None:
        chunk_chapters(chapters_from_documents(batch)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, n, total) by tumbling windows; rows later than the watermark are dropped."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
