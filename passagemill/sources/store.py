"""The passage table and its full-text index on disk: written whole, read with their schemas, projected and counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.operators import bm25
from passagemill.schema import CHUNK, NUMBERS, POSTING, TERM
from passagemill.tables import spread


def recreate(chunks: DataFrame, path: str) -> None:
    """Replace the table and its index: postings by shard of passages, the terms, and last the numbers."""
    write_table(chunks, path)
    write_index(chunks.sparkSession, path)


def write_table(chunks: DataFrame, path: str) -> None:
    chunks.select(*(F.col(f.name).cast(f.dataType) for f in CHUNK.fields)).write.mode("overwrite").parquet(f"{path}/chunks")


def write_index(spark: SparkSession, path: str) -> None:
    stored = open_table(spark, path)
    bm25.sharded(stored.select("id", "text")).write.mode("overwrite").parquet(f"{path}/postings")
    p = spark.read.schema(POSTING).parquet(f"{path}/postings")
    bm25.term_counts(p).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    spark.createDataFrame([bm25.numbers(p)], NUMBERS).coalesce(1).write.mode("overwrite").parquet(f"{path}/numbers")


def open_table(spark: SparkSession, path: str) -> DataFrame:
    return spread(spark.read.schema(CHUNK).parquet(f"{path}/chunks"))


def open_index(spark: SparkSession, path: str) -> bm25.Index:
    n, mean = spark.read.schema(NUMBERS).parquet(f"{path}/numbers").first()
    return bm25.Index(spark.read.schema(POSTING).parquet(f"{path}/postings"), spark.read.schema(TERM).parquet(f"{path}/terms"), n, mean)


def with_places(chunks: DataFrame) -> DataFrame:
    """The table's rows with chunk_index, which their ids end with."""
    return chunks.withColumn("chunk_index", F.split_part("id", F.lit("-"), F.lit(-1)).cast("int"))


def info(spark: SparkSession, path: str) -> dict[str, object]:
    return {"path": path, "rows": open_table(spark, path).count()}


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
