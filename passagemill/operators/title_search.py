"""Chapters that a question names, and the passages of those chapters.

Verbatim titles are found through all of their words: a title's words stand whole and in a row
in a question that holds it, so titles and runs of a question's words meet in a hash join and
only those pairs run the title's expression.  Near titles meet on exact tokens, prefixes and
deletion neighbours, which every covering pair of tokens shares; a title is tried only with the
questions that cover its rarest token, and must have all of its tokens covered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from passagemill.functions import titles as T
from passagemill.operators import bm25
from passagemill.options import TUNING, Tuning
from passagemill.tables import asked_once, for_each, small, written

_WORD = "([A-Za-z0-9_]+)"


def chapter_list(chunks: DataFrame) -> DataFrame:
    """(chapter, chapter_pos): distinct chapters in the order of their first passage."""
    return chunks.groupBy("chapter").agg(F.min(F.struct("order", "chunk_index")).alias("chapter_pos")).where("chapter is not null")


def _title_words(c):
    return F.transform(F.regexp_extract_all(c, F.lit(_WORD), F.lit(1)), F.lower)


def matched_titles(questions: DataFrame, chapters: DataFrame) -> DataFrame:
    """(qid, chapter, chapter_pos) of titles that stand verbatim in a question."""
    t = chapters.withColumn("pattern", T.title_pattern(F.col("chapter"))).withColumn("words", _title_words(F.col("chapter")))
    t = written(t.withColumn("n", F.size("words")).withColumn("key", F.xxhash64("words")).drop("words"), "titles-by-words")
    q = questions.select("qid", "question").withColumn("words", _title_words(F.col("question")))
    sizes = F.array(*(F.lit(r["n"]) for r in t.where("n > 0").select("n").distinct().collect())).cast("array<int>")
    found = F.expr("regexp_like(question, pattern)")
    # Every word of a title is whole in any match, whatever stands at the title's edges.
    runs = F.transform(F.filter(sizes, lambda n: n <= F.size("words")), lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.xxhash64(F.slice("words", i, n))))
    hit = q.select("qid", F.explode(F.array_distinct(F.flatten(runs))).alias("key")).join(t.where("n > 0").select("key", "chapter", "chapter_pos", "pattern"), "key")
    # One without words is all that stands between two words; an empty one, of which a list has one at most, meets every question.
    gaps = F.array_distinct(F.filter(F.split("question", _WORD), lambda g: g != ""))
    bare = q.select("qid", F.explode(gaps).alias("chapter")).join(t.where("n = 0 and chapter <> ''").drop("key", "n"), "chapter")
    pairs = hit.select("qid", "chapter", "chapter_pos", "pattern").unionByName(bare.select("qid", "chapter", "chapter_pos", "pattern"))
    empty = q.crossJoin(F.broadcast(t.where("n = 0 and chapter = ''"))).where(found)
    cols = ["qid", "chapter", "chapter_pos"]
    return pairs.join(q.select("qid", "question"), "qid").where(found).select(*cols).unionByName(empty.select(*cols)).distinct()


def _short(token):
    """The token short of one letter, in every way."""
    n = F.length(token)
    return F.when(n >= 6, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substr(token, F.lit(1), i - 1), F.substr(token, i + 1)))).otherwise(F.array().cast("array<string>"))


def _prefixes(token):
    """Its beginnings of four letters or more that are shorter than itself."""
    n = F.length(token)
    return F.when(n >= 5, F.transform(F.sequence(F.lit(4), F.greatest(n - 1, F.lit(4))), lambda i: F.substr(token, F.lit(1), i))).otherwise(F.array().cast("array<string>"))


def _keys(token, question: bool):
    """Keys of which covering tokens share one: a token meets itself, its beginnings, what it begins, and what is like it short of one letter."""
    # Two words a swap apart share a word short of one letter, as those a substitution apart do.
    signs = ("<", ">") if question else (">", "<")
    own = F.array(*(F.concat(F.lit(x), token) for x in ("=", signs[0], "-")))
    return F.array_distinct(F.concat(own, F.transform(_prefixes(token), lambda p: F.concat(F.lit(signs[1]), p)), F.transform(_short(token), lambda x: F.concat(F.lit("-"), x))))


def near_titles(questions: DataFrame, chapters: DataFrame) -> DataFrame:
    """(qid, chapter, chapter_pos) of titles with two tokens or more, every one covered by a token of the question."""
    q = questions.select("qid", F.array_distinct(T.near_tokens(F.col("question"))).alias("qs"))
    t = chapters.withColumn("tokens", T.near_tokens(F.col("chapter"))).where(F.size("tokens") >= 2).select("chapter", "chapter_pos", F.array_distinct("tokens").alias("ts"))
    q, t = written(q, "question-tokens"), written(t, "title-tokens")
    asked = q.select("qid", F.explode("qs").alias("q"))
    held = t.select("chapter", F.size("ts").alias("needed"), F.explode("ts").alias("t"))
    often = asked.groupBy("q").agg(F.count("*").alias("n"))
    words = held.select("t").distinct().select("t", F.explode(_keys(F.col("t"), False)).alias("key"))
    pairs = often.select("q", "n", F.explode(_keys(F.col("q"), True)).alias("key")).join(words, "key").select("q", "t", "n").distinct().where(T.covers(F.col("q"), F.col("t")))
    pairs = written(pairs, "covering")
    # All of a title's tokens must be covered, so the questions of the one that fewest cover are enough.
    per = pairs.groupBy("t").agg(F.sum("n").alias("n"))
    rare = held.join(per, "t").groupBy("chapter").agg(F.min_by("t", F.struct("n", "t")).alias("t"), F.count("*").alias("met"), F.first("needed").alias("needed")).where("met = needed")
    tried = rare.select("chapter", "t").join(pairs.select("q", "t"), "t").select("chapter", "q").join(asked, "q").select("qid", "chapter").distinct()
    all_met = F.forall("ts", lambda x: F.exists("qs", lambda y: T.covers(y, x)))
    return tried.join(q, "qid").join(t, "chapter").where(all_met).select("qid", "chapter", "chapter_pos")


def longest(titles: DataFrame, n: int) -> DataFrame:
    """The n longest titles of each question, with their rank; ties go by the chapter's place."""
    w = W.Window.partitionBy("qid").orderBy(F.desc(F.length("chapter")), "chapter_pos", "chapter")
    return titles.withColumn("title_rank", F.row_number().over(w)).where(F.col("title_rank") <= n)


def scoped_chapters(questions: DataFrame, chapters: DataFrame, tuning: Tuning = TUNING) -> DataFrame:
    """(qid, chapter): the longest named titles, and the longest near ones that are not among those."""
    named = longest(matched_titles(questions, chapters), tuning.named_titles)
    near = near_titles(questions, chapters).join(named.select("qid", "chapter"), ["qid", "chapter"], "left_anti")
    return named.select("qid", "chapter").unionByName(longest(near, tuning.near_titles).select("qid", "chapter"))


def title_search(questions: DataFrame, chunks: DataFrame, k: int = TUNING.title_k, tuning: Tuning = TUNING, index: bm25.Index | None = None) -> DataFrame:
    """(qid, id, rank): passages of the named chapters by BM25, then those that hold a symbol, then any, first place first."""
    # A question's words decide: as many chapters of one title ask the same, each question is searched once.
    once, same = asked_once(questions)
    return for_each(_title_search(once, chunks, k, tuning, index), same).select("qid", "id", "rank")


def _title_search(questions: DataFrame, chunks: DataFrame, k: int, tuning: Tuning, index: bm25.Index | None) -> DataFrame:
    # Three branches read it; matching titles is dearer than keeping (qid, chapter) pairs.
    scope = written(scoped_chapters(questions, chapter_list(chunks), tuning), "scope")
    scope = small(scope, F.length("chapter") * 4 + 32)
    inside = chunks.join(scope, "chapter").select("qid", "id", "order", "chunk_index", "text")
    fts = bm25.search(index or bm25.index(chunks), questions, k, scope=inside.select("qid", "id")).select("qid", "id", F.lit(1).alias("source"), F.col("rank").alias("place"))
    reading = W.Window.partitionBy("qid").orderBy("order", "chunk_index", "id")
    symbols = questions.select("qid", F.explode(F.array_distinct(T.symbol_tokens(F.col("question")))).alias("symbol"))
    # An underscore stands for any one character here.
    holds = inside.join(symbols, "qid").where(F.expr("text like concat('%', symbol, '%')")).select("qid", "id", "order", "chunk_index").distinct()
    sym = holds.withColumn("place", F.row_number().over(reading)).where(F.col("place") <= tuning.symbol_k).select("qid", "id", F.lit(2).alias("source"), "place")
    enough = fts.groupBy("qid").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    plain = inside.select("qid", "id", "order", "chunk_index").join(enough, "qid", "left_anti").withColumn("place", F.row_number().over(reading)).where(F.col("place") <= k).select("qid", "id", F.lit(3).alias("source"), "place")
    first = fts.unionByName(sym).unionByName(plain).groupBy("qid", "id").agg(F.min(F.struct("source", "place")).alias("at"))
    w = W.Window.partitionBy("qid").orderBy("at", "id")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k + tuning.title_extra).select("qid", "id", "rank")
