"""Row types of the engine's tables, enforced on reading."""

from pyspark.sql import types as T

CHAPTER = T.StructType([T.StructField("title", T.StringType()), T.StructField("href", T.StringType()), T.StructField("order", T.LongType()), T.StructField("text", T.StringType())])
CHUNK = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("text", T.StringType()),
        T.StructField("chapter", T.StringType()),
        T.StructField("order", T.LongType()),
    ]
)
_PLACES = T.ArrayType(T.IntegerType())
POSTING = T.StructType([T.StructField("shard", T.LongType()), T.StructField("term", T.StringType()), T.StructField("at", _PLACES), T.StructField("tf", _PLACES), T.StructField("ids", T.ArrayType(T.StringType()))])
TERM = T.StructType([T.StructField("term", T.StringType()), T.StructField("df", T.LongType())])
NUMBERS = T.StructType([T.StructField("n_docs", T.LongType()), T.StructField("avg_len", T.DoubleType())])
