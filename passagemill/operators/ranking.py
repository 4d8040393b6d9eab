"""From candidate lists to kept passages: union, two-stage scores, threshold, cap and pins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from passagemill.functions import titles as T
from passagemill.operators.title_search import longest
from passagemill.options import TUNING, Tuning


def merge(*sources: DataFrame, payload: str | None = None) -> DataFrame:
    """(qid, id, pos): ranked lists one after another; an id stands where it first occurs, with its last payload."""
    cols = ["qid", "id", "rank", *([payload] if payload else [])]
    all_ = reduce(DataFrame.unionByName, (s.select(*cols, F.lit(i).alias("source")) for i, s in enumerate(sources)))
    at = F.struct("source", "rank")
    aggs = [F.min(at).alias("at"), *([F.max_by(payload, at).alias(payload)] if payload else [])]
    w = W.Window.partitionBy("qid").orderBy("at", "id")
    one = all_.groupBy("qid", "id").agg(*aggs)
    return one.select("qid", "id", F.row_number().over(w).cast("int").alias("pos"), *([payload] if payload else []))


def prefilter(pool: DataFrame, score: str = "cheap", keep: int = TUNING.prefilter_keep) -> DataFrame:
    """The pool's best by the cheap score; a pool that is small enough passes whole."""
    w = W.Window.partitionBy("qid").orderBy(F.desc(score), "pos")
    return pool.withColumn("cheap_rank", F.row_number().over(w)).where(F.col("cheap_rank") <= keep)


def ranked(scored: DataFrame) -> DataFrame:
    """Scored candidates best first; those without a finite score are dropped, ties keep their place."""
    w = W.Window.partitionBy("qid").orderBy(F.desc("score"), "pos")
    return scored.where("score is not null and not isnan(score) and abs(score) < double('inf')").withColumn("rank", F.row_number().over(w))


def rank_and_pin(scored: DataFrame, titles: DataFrame, questions: DataFrame, tuning: Tuning = TUNING) -> DataFrame:
    """(scored's columns, kept_rank, pinned): passages above the threshold, one to a chapter unless its title was named, then pins.

    titles: (qid, chapter, chapter_pos) named verbatim.  A pin is the best passage of one of the
    longest named titles that has none kept, one with a symbol of the question first.
    """
    cols = scored.columns
    named = longest(titles, 1 << 30).select("qid", "chapter", "title_rank")
    symbols = questions.select("qid", T.symbol_tokens(F.col("question")).alias("symbols"))
    x = scored.where(F.col("score") >= tuning.threshold).join(named, ["qid", "chapter"], "left").join(symbols, "qid", "left")
    x = x.withColumn("has_symbol", F.coalesce(F.exists("symbols", lambda s: F.contains(F.col("text"), s)), F.lit(False)))
    by_chapter = W.Window.partitionBy("qid", "chapter")
    x = x.withColumn("crn", F.row_number().over(by_chapter.orderBy(F.desc("score"), "pos"))).withColumn("srn", F.row_number().over(by_chapter.orderBy(F.desc("has_symbol"), F.desc("score"), "pos")))
    allowed = F.col("title_rank").isNotNull() | (F.col("crn") == 1)
    order = W.Window.partitionBy("qid").orderBy(F.desc("allowed"), F.desc("score"), "pos")
    x = x.withColumn("allowed", allowed).withColumn("kept_rank", F.row_number().over(order))
    x = x.withColumn("kept", F.col("allowed") & (F.col("kept_rank") <= tuning.keep))
    x = x.withColumn("chapter_kept", F.max("kept").over(by_chapter))
    x = x.withColumn("pinned", ~F.col("chapter_kept") & (F.col("title_rank") <= tuning.named_titles) & (F.col("srn") == 1))
    x = x.where(F.col("kept") | F.coalesce("pinned", F.lit(False)))
    final = W.Window.partitionBy("qid").orderBy("pinned", F.when(F.col("pinned"), F.col("title_rank")).otherwise(F.col("kept_rank")))
    x = x.withColumn("pinned", F.coalesce("pinned", F.lit(False)))
    return x.select(*cols, F.row_number().over(final).alias("kept_rank"), "pinned")
