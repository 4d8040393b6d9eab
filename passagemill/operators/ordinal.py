"""A running number over a whole table's order without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from passagemill.tables import written


def with_ordinal(df: DataFrame, order: list[str], name: str, where: str | None = None) -> DataFrame:
    """df with name: 0, 1, 2, ... in the given order, which should have no ties.

    df is made once and kept as a table; its order columns alone are read again, to split it
    into ranges of about equal size and to count those.  Numbers run within a range, and the
    ranges' counts carry them on.  where: rows that count; a condition before it would have columns worked out twice.
    """
    df = written(df, "unnumbered")
    df = df.where(where) if where else df
    spark = df.sparkSession
    ranged = df.select(*order).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_r", F.spark_partition_id())
    edges = ranged.groupBy("_r").agg(F.min(F.struct(*order)).alias("lo"), F.count("*").alias("n")).orderBy("lo").collect()
    inner = W.Window.orderBy(*order)
    if len(edges) < 2:
        return df.withColumn(name, F.row_number().over(inner.partitionBy(F.lit(0))) - 1)
    kind = ranged.select(F.struct(*order).alias("x")).schema["x"].dataType.simpleString()
    rows, before = [], 0
    for i, e in enumerate(edges):
        rows.append((i + 1, e["lo"], before))
        before += e["n"]
    bounds = spark.createDataFrame(rows, f"_r int, lo {kind}, _b bigint")
    listed = bounds.groupBy().agg(F.sort_array(F.collect_list("lo")).alias("los"))  # one row, of as many edges as partitions
    x = df.crossJoin(F.broadcast(listed)).withColumn("_r", F.size(F.filter("los", lambda b: b <= F.struct(*order)))).drop("los")
    x = x.withColumn("_i", F.row_number().over(inner.partitionBy("_r"))).join(F.broadcast(bounds.select("_r", "_b")), "_r")
    return x.withColumn(name, F.col("_b") + F.col("_i") - 1).drop("_r", "_i", "_b")
