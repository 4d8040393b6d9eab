"""The stored index and what reads it, against plain loops over small made-up passages."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagemill import tables
from passagemill.functions import vectors as V
from passagemill.functions.text import tokens
from passagemill.operators import bm25, metrics
from passagemill.plans import retrieve as R
from passagemill.plans.ingest import ingest
from passagemill.sources import providers, store
from passagemill.sources.providers import Providers


def _prose(seed, n, words=60):
    r = random.Random(seed)
    return " ".join(f"w{int(r.paretovariate(0.7)) % words}" for _ in range(n))


def _bm25(chunks, questions, k):
    """Every passage scored for every question, term by term."""
    split = {i: t.split() for i, t in chunks if t}
    mean = sum(map(len, split.values())) / len(split)
    df = Counter(w for ws in split.values() for w in set(ws))
    out = set()
    for q, text in questions:
        got = []
        for i, ws in split.items():
            s, tf = 0.0, Counter(ws)
            for w in set(text.split()):
                if tf[w]:
                    s += math.log(1 + (len(split) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean))
            if s:
                got.append((-round(s, 6), i))
        out |= {(q, i, rank + 1) for rank, (_, i) in enumerate(sorted(got)[:k])}
    return out


def test_search_over_shards_and_blocks_is_that_of_plain_loops(spark, monkeypatch):
    chunks = [(f"c{i:03}", _prose(i, 5 + i % 40)) for i in range(150)] + [("twin-b", _prose(3, 8)), ("twin-a", _prose(3, 8)), ("none", None), ("empty", "")]
    questions = [(i, _prose(900 + i, 6)) for i in range(20)] + [(30, "unknown"), (31, "")]
    c = spark.createDataFrame(chunks, "id string, text string")
    q = spark.createDataFrame(questions, "qid bigint, question string")
    want = _bm25(chunks, questions, 7)
    found = lambda source, **kw: {(r.qid, r.id, r["rank"]) for r in bm25.search(source, q, 7, **kw).collect()}
    assert found(c) == want
    monkeypatch.setattr(bm25, "SHARD_ROWS", 10)
    monkeypatch.setattr(bm25, "_CELLS", 40)
    monkeypatch.setattr(bm25, "LISTED", 3)
    assert found(c) == want and found(bm25.index(c), block=9) == want
    scope = q.crossJoin(c.where("id < 'c020'")).select("qid", "id")
    inside = {(q, i) for q, i, _ in _bm25(chunks, questions, 999) if i < "c020"}
    assert {(r.qid, r.id) for r in bm25.search(c, q, 999, scope=scope).collect()} == inside
    assert bm25.search(c.where("false"), q, 7).count() == bm25.search(c, q.where("false"), 7).count() == 0


def test_stored_index_is_that_of_the_passages(spark, tmp_path):
    chapters = spark.createDataFrame([(f"t{i}", "", i, _prose(i, 400)) for i in range(12)], "title string, href string, order bigint, text string")
    path = str(tmp_path / "lib")
    ingest(chapters, path)
    chunks, ix = store.with_places(store.open_table(spark, path)), store.open_index(spark, path)
    q = spark.createDataFrame([(i, _prose(70 + i, 5)) for i in range(5)], "qid int, question string")
    rows = lambda s: sorted(map(tuple, bm25.search(s, q, 4).collect()))
    assert rows(ix) == rows(chunks) and len(rows(ix)) == 20 and ix.n_docs == chunks.count()
    kept = lambda **kw: sorted((r.qid, r.id, r.kept_rank) for r in R.retrieve(q, chunks, **kw).kept.collect())
    assert kept(index=ix) == kept()
    before = tables.fingerprint(spark, path)
    assert before == tables.fingerprint(spark, path) and tables.present(spark, f"{path}/numbers") and not tables.present(spark, f"{path}/nothing")
    ingest(chapters.limit(3), path)
    assert tables.fingerprint(spark, path) != before


def test_hashed_words(spark):
    texts = ["a b a", "", None, "Zoë zoë x"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.v for r in df.select(V.hashed_words(tokens(F.col("text")), 8).alias("v")).collect()]
    for t, v in zip(texts, got):
        if t is None:
            assert v is None
            continue
        want = np.zeros(8)
        for w in t.lower().split():
            want[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 8] += 1
        assert v == (want / max(np.linalg.norm(want), 1e-300)).tolist()


def test_first_k():
    r = np.random.default_rng(0)
    v, ok = r.integers(0, 4, (9, 30)).astype(float), r.random((9, 30)) < 0.5
    row, col = V.first_k(v, 5, ok)
    want = [(i, j) for i in range(9) for j in sorted(np.flatnonzero(ok[i]), key=lambda j: (v[i, j], j))[:5]]
    assert list(zip(row, col)) == want
    assert len(V.first_k(np.zeros((2, 0)), 5, np.zeros((2, 0), bool))[0]) == 0


def test_gates_and_backends(spark):
    cases = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "kind string, passed boolean")
    assert {(r.kind, r.ok) for r in metrics.gate(metrics.pass_rate(cases, "kind"), 60).collect()} == {("a", False), ("b", True), (None, True)}
    a = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 5, 1), (2, 6, 2), (3, 1, 1)], "qid int, id int, rank int")
    b = spark.createDataFrame([(1, 6, 1), (1, 5, 2), (2, 5, 1), (2, 7, 2)], "qid int, id int, rank int")
    assert tuple(metrics.same_top(a, b, "id", 2).first()) == (3, 1, round(1 / 3, 6))


def test_judged(spark):
    kept = spark.createDataFrame([(1, 1, "Timer", 0, 1.0, "a timer counts down the time until it has run out"), (2, 1, "Node", 1, 1.0, "unrelated words of which none were asked about")], "qid int, kept_rank int, chapter string, order int, score double, text string")
    q = spark.createDataFrame([(1, "what counts down"), (2, "zebra quantum"), (3, "nothing kept"), (4, None)], "qid int, question string")
    got = {r.qid: tuple(r)[1:] for r in R.judged(q, kept).collect()}
    assert got == {1: (False, True, True, "", True), 2: (False, True, False, "", True), 3: (True, None, None, None, None)}
    mute = Providers(judge=lambda df: df.withColumn("reply", F.lit("no json")))
    assert {r.qid: (r.refused, r.grounded) for r in R.judged(q, kept, mute).collect()} == {1: (False, None), 2: (False, None), 3: (True, None)}


def test_expansion_fails_with_one_warning():
    providers._warned.clear()
    with pytest.warns(UserWarning) as seen:
        for _ in range(3):
            providers._warn_once("no expansion: x")
    assert len(seen) == 1


def test_shared_folder_must_be_named_on_a_cluster():
    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "getConf": staticmethod(lambda: type("C", (), {"get": staticmethod(lambda *a: None)}))})

    with pytest.raises(RuntimeError):
        tables.shared_dir(Cluster)
