"""Steps that must not grow faster than their input, against plain loops."""

import random
import re
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from passagemill.functions import titles as T
from passagemill.functions import vectors as V
from passagemill.functions.text import tokens
from passagemill.operators import bm25, knn, metrics, title_search
from passagemill.plans import catalog
from passagemill.plans import retrieve as R
from passagemill.sources.providers import Providers


def _covers(q, t):
    prefix = len(q) >= 4 and len(t) >= 4 and (q.startswith(t) or t.startswith(q))
    return q == t or prefix or (len(q) >= 6 and len(t) >= 6 and abs(len(q) - len(t)) <= 1 and T.edit_distance(q, t) <= 1)


def test_titles_are_those_of_all_pairs(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice(["th", "on", "ti", "é", "a", "er", "X"]) for _ in range(r.randint(1, 4)))
    names = sorted({" ".join(word() for _ in range(r.randint(1, 3))) + r.choice(["", ".", "é"]) for _ in range(120)} | {"é", "foo bar", "(on", "thonti erthon", ""})
    asked = [f"Tell me about {n}." for n in names] + ["aéb", "Kfoo bar!", "the(onx", "thonit erthons", ""]
    lst = spark.createDataFrame(list(enumerate(names)), "chapter_pos int, chapter string")
    q = spark.createDataFrame(list(enumerate(asked)), "qid int, question string")
    pattern = {n: lst_p for n, lst_p in lst.select("chapter", T.title_pattern(F.col("chapter"))).collect()}
    want = {(i, n) for (i, x), n in product(enumerate(asked), names) if re.search(pattern[n], x, re.ASCII)}
    assert {(x.qid, x.chapter) for x in title_search.matched_titles(q, lst).collect()} == want
    near = lambda s: {w for w in re.findall("[a-z0-9_]+", s.lower()) if w not in T.STOP}
    listed = lambda s: [w for w in re.findall("[a-z0-9_]+", s.lower()) if w not in T.STOP]
    want = {(i, n) for (i, x), n in product(enumerate(asked), names) if len(listed(n)) >= 2 and all(any(_covers(a, b) for a in near(x)) for b in near(n))}
    assert {(x.qid, x.chapter) for x in title_search.near_titles(q, lst).collect()} == want and len(want) > 50


def test_questions_that_repeat_are_searched_once(spark):
    chunks = spark.createDataFrame([(f"{i}-0", "Same title 1", i, 0, f"same words number {i}") for i in range(6)], "id string, chapter string, order bigint, chunk_index int, text string")
    q = spark.createDataFrame([(i, "Tell me about Same title 1.") for i in range(5)] + [(9, "number 3"), (8, "number 3")], "qid bigint, question string")
    asked = []

    def embed(df):
        asked.append(df.count())
        return df.withColumn("vector", V.hashed_text(F.col("text")))

    d = R.retrieve(q, chunks, Providers(embed_query=embed))
    assert asked == [2]
    for df in (d.titles, d.candidates, d.scored, d.kept):
        rows = [tuple(sorted(map(str, (x.asDict() | {"qid": 0}).values())) for x in df.where(F.col("qid") == i).collect()) for i in range(5)]
        assert all(sorted(x) == sorted(rows[0]) for x in rows) and rows[0]
    assert {x.qid for x in d.texts.collect()} == {0, 1, 2, 3, 4, 8, 9}


def test_many_queries_meet_all_rows_without_a_shuffle_of_pairs(spark, monkeypatch):
    r = np.random.default_rng(5)
    x = r.integers(-3, 4, (150, 4)).astype(float)  # many ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "id bigint, vector array<double>")
    q = df.withColumnRenamed("id", "qid")
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    want = lambda own: {(a, b, n + 1, d[a, b]) for a in range(150) for n, b in enumerate([b for b in np.lexsort((np.arange(150), d[a])) if own or a != b][:7])}
    got = lambda **kw: {tuple(row) for row in knn.nearest(q, df, 7, **kw).select("qid", "id", "rank", "distance").collect()}
    few = got(), got(not_self=True, block=40)
    monkeypatch.setattr(knn, "FEW", 10)
    monkeypatch.setattr(knn, "_HELD", 70)
    monkeypatch.setattr(knn, "_CELLS", 300)
    assert few == (got(block=33), got(not_self=True)) == (want(True), want(False))
    assert "Window" not in knn.nearest(q, df, 7)._jdf.queryExecution().toString()


def test_words_are_those_of_the_expression(spark):
    texts = ["Zoë's x2 über-Straße ⅷ ９ 中文 İstanbul \U0001d51f \U00020000b", "", None, "a" * 41 + " " + "b" * 40, "n\n\nn ́e", "ΟΔΟΣ. a_b"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    want = [x.w or [] for x in df.orderBy("i").select(tokens(F.col("text")).alias("w")).collect()]
    row, code, words = V.split_words(pa.array([x[0] for x in df.orderBy("i").select(F.lower("text")).collect()]))
    assert [[words[c].as_py() for c in code[row == i]] for i in range(len(texts))] == want
    assert [len(p) for p in V.pieces(pa.array(["abc", "de", None, "f" * 9, "g"]), pa.array(["abc", "de", None, "f" * 9, "g"]), 5)] == [3, 1, 1]
    a, b = df.orderBy("i").select(V.hashed_text(F.col("text")), V.hashed_words(tokens(F.col("text")))).collect()[0]
    assert a == b


def test_index_is_made_where_the_passages_lie(spark, monkeypatch):
    monkeypatch.setattr(bm25, "SHARD_ROWS", 4)
    monkeypatch.setattr(V, "PIECE_BYTES", 20)
    texts = [(f"p{i}", "w x " * (i % 3) + f"w{i % 5}") for i in range(30)] + [("none", None), ("p0", "twice w")]
    df = spark.createDataFrame(texts, "id string, text string")
    p = bm25.sharded(df.where("id not in ('p0')"))
    assert "Exchange" not in p._jdf.queryExecution().toString()
    merged = {}
    for i, t in texts:
        merged[i] = f"{merged.get(i, '')} {t or ''}".split()
        merged[i] = " ".join(merged[i])
    p = bm25.sharded(df)
    ids = {(x.shard, at): (i, n) for x in p.where("term is null").collect() for at, (i, n) in enumerate(zip(x.ids, x["at"]))}
    got = {(ids[x.shard, at][0], x.term): n for x in p.where("term is not null").collect() for at, n in zip(x["at"], x.tf)}
    assert got == {(i, w): t.split().count(w) for i, t in merged.items() for w in set(t.split())}
    assert dict(ids.values()) == {i: len(t.split()) for i, t in merged.items()}
    assert bm25.numbers(p) == (30, sum(len(t.split()) for t in merged.values()) / 30)
    one = df.where("id <> 'p0'")
    assert {tuple(x) for x in bm25.term_totals(one, "id").collect()} == {(w, sum(w in t.split() for i, t in texts if i != "p0" and t), sum(t.split().count(w) for i, t in texts if i != "p0" and t)) for i, t in texts if i != "p0" and t for w in t.split()}


def test_holders(spark):
    items = [(1, "ab cd ef"), (2, "b c"), (3, "zz"), (4, ". a, b ."), (5, None), (6, "x" * 50 + " y " + "z")]
    docs = [("a", "xab cd efy"), ("b", "ab CD ef"), ("c", "b c zz"), ("d", ". a, b ."), ("e", None), ("f", "x" * 50 + " y zz")]
    found = metrics.holders(spark.createDataFrame(items, "qid int, text string"), spark.createDataFrame(docs, "chapter string, text string"))
    assert {(x.qid, x.chapter) for x in found.collect()} == {(q, c) for (q, i), (c, t) in product(items, docs) if i and t and i in t}


def test_stored_passages_for_searches_are_not_embedded(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text number {i} of a few", "en", "src") for i in range(5)], "doc_id bigint, text string, lang string, source string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    chunks, ix = catalog.library(spark, str(tmp_path), "documents")
    assert chunks.count() == ix.n_docs == 5 and "vector" not in chunks.columns
