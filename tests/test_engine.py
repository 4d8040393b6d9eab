"""Behaviour vectors of the retrieval engine, and small simulations of its folds and windows."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from passagemill import options
from passagemill.functions import answers as A
from passagemill.functions import text as X
from passagemill.functions import titles as T
from passagemill.functions import vectors as V
from passagemill.operators import bm25, knn, ranking, title_search
from passagemill.operators.chunking import chunk_chapters, first_chunks
from passagemill.operators.ordinal import with_ordinal
from passagemill.plans import retrieve as R
from passagemill.plans.ingest import ingest
from passagemill.sources import epub, pages, store
from passagemill.sources.providers import Providers


def col(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "html,text",
    [
        ("<style>b{}</style><h1>Head</h1><p>Say <i>so</i>.</p><SCRIPT>x()</SCRIPT>", "Head\nSay so."),
        ("<p>&lt;A&gt; &amp; &#65;&#39;&nbsp;&quot;</p>", "<A> & A' \""),
        ("<div> one   two </div>\n\n\n<br> three", "one two\n\nthree"),
        ("&amp;lt; &amp;#66; &copy; &#x41; &#128279; &#99999999;", "&lt; B &copy; &#x41; \U0001f517 &#99999999;"),
        ("a</pre>b<p>c", "a\nbc"),
        ("", ""),
    ],
)
def test_html(spark, html, text):
    assert col(spark, html, X.html_to_text) == text


def test_strip_and_heading(spark):
    assert col(spark, "﻿  \n a b ", X.strip_space) == "a b"
    assert col(spark, "<H1 id=x> A\n <b>B</b></H1><h1>C</h1>", X.heading) == "A B"
    assert col(spark, f"<h1>{'x' * 121}</h1>", X.heading) is None and col(spark, "<p>", X.heading) is None


def _split(text, budget=1800, overlap=240):
    """A plain loop over paragraphs, as the behaviour is described."""
    out, cur = [], ""
    for p in (p.strip() for p in __import__("re").split("\n{2,}", text)):
        if not p:
            continue
        if cur and len(cur) + len(p) + 1 > budget:
            out.append(cur)
            tail = cur[-overlap:]
            cur = cur if len(cur) <= overlap else tail[tail.find(" ") + 1 :]
        cur = f"{cur}\n{p}" if cur else p
        while len(cur) > budget * 1.5:
            out.append(cur[:budget])
            cur = cur[budget - overlap :]
    return out + ([cur] if cur.strip() else [])


def test_chunks(spark):
    r = random.Random(4)
    texts = ["x" * 3600, "a" * 1000 + "\n\n" + "b" * 1000, "", None, "short"]
    texts += ["\n\n".join(" ".join("w" * r.randint(1, 9) for _ in range(r.choice([3, 80, 300, 900]))) for _ in range(r.randint(1, 6))) for _ in range(40)]
    df = spark.createDataFrame([(str(i), "", i, t) for i, t in enumerate(texts)], "title string, href string, order bigint, text string")
    got = {}
    for c in chunk_chapters(df).orderBy("order", "chunk_index").collect():
        assert c.id == f"{c.order}-{c.chunk_index}" and c.chapter == str(c.order)
        got.setdefault(c.order, []).append(c.text)
    assert got == {i: _split(t) for i, t in enumerate(texts) if t and _split(t)}
    assert got[0][0] == "x" * 1800 and got[0][1].startswith(got[0][0][-240:])
    assert len(got[1]) == 2 and "b" not in got[1][0]
    assert first_chunks(chunk_chapters(df), 3).count() == 3 and first_chunks(chunk_chapters(df), 0).count() == sum(map(len, got.values()))


def test_titles(spark):
    df = spark.createDataFrame([("andriod", "android"), ("node", "mode"), ("stop", "step"), ("export", "exporting"), ("abcdef", "abcdef"), ("sprite", "node"), ("ab", "ba")], "a string, b string")
    got = [(r.c, r.e) for r in df.select(T.covers(F.col("a"), F.col("b")).alias("c"), T.within_one_edit(F.col("a"), F.col("b")).alias("e")).collect()]
    assert got == [(True, True), (False, True), (False, True), (True, False), (True, True), (False, False), (False, True)]
    assert T.edit_distance("andriod", "android") == T.edit_distance("node", "mode") == 1 and T.edit_distance("node", "sprite") > 1
    assert [col(spark, t, T.distinctive) for t in ("Sprite2D", "AnimationPlayer", "Control")] == [True, True, False]
    assert col(spark, "Call _physics_process, get_node_or_null or TYPE_INT.", T.symbol_tokens) == ["_physics_process", "get_node_or_null", "TYPE_INT"]
    assert col(spark, "What does CharacterBody2D do every frame?", T.symbol_tokens) == []
    assert col(spark, "How do I export to the Android_x?", T.near_tokens) == ["export", "android_x"]


def test_one_edit_against_alignment(spark):
    r = random.Random(9)
    pairs = [tuple("".join(r.choice("abc") for _ in range(r.randint(1, 7))) for _ in range(2)) for _ in range(600)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.within_one_edit(F.col("a"), F.col("b")).alias("e")).collect()
    assert all(x.e == (T.edit_distance(x.a, x.b) <= 1) for x in got)


def test_title_matching(spark):
    titles = ["Tween", "Sprite2D", "C#", "Singletons (Autoload)", "Exporting for Android", "Tree", "Été 1", "Node"]
    lst = spark.createDataFrame([(t, i) for i, t in enumerate(titles)], "chapter string, chapter_pos int")
    q = spark.createDataFrame([(0, "use a Tweené or Tween!"), (1, "what is sprite2d for"), (2, "C# please; tree"), (3, "export my game to andriod"), (4, "Tree_x, Node."), (5, "")], "qid int, question string")
    got = {(r.qid, r.chapter) for r in title_search.matched_titles(q, lst).collect()}
    assert got == {(0, "Tween"), (1, "Sprite2D"), (4, "Node")}
    assert {(r.qid, r.chapter) for r in title_search.near_titles(q, lst).collect()} == {(3, "Exporting for Android")}


def test_answers(spark):
    assert col(spark, f"'{A.NOT_FOUND}' and so on", A.is_refusal) and not col(spark, "Yes.", A.is_refusal)
    assert col(spark, "<think>x</think> A, B ", A.term_list) == "A, B" and col(spark, "It is. So, no.", A.term_list) == "" and col(spark, "NONE, x", A.term_list) == ""
    assert col(spark, '{"choices": [{"message": {"content": "hi"}}]}', A.completion_text) == "hi"
    got = [tuple(col(spark, x, A.parse_member) or ()) for x in ("Color get_c() const", "hit()", "MAX_N = 2", "bool on = true", "?")]
    assert got == [("method", "get_c"), ("signal", "hit"), ("constant", "MAX_N"), ("property", "on"), ()]
    assert col(spark, float(3 << 29), A.format_gib, "double") == "1.50 GiB"


def test_merge_and_ranking(spark):
    one = spark.createDataFrame([(1, "a", 1, "old")], "qid int, id string, rank int, p string")
    two = spark.createDataFrame([(1, "a", 1, "new"), (1, "b", 2, "b")], "qid int, id string, rank int, p string")
    assert [tuple(r) for r in ranking.merge(one, two, payload="p").orderBy("pos").collect()] == [(1, "a", 1, "new"), (1, "b", 2, "b")]


def _greedy(pool, titles, symbols, keep=5, threshold=-4.0):
    best = sorted((p for p in pool if p["score"] >= threshold), key=lambda p: (-p["score"], p["pos"]))
    kept = []
    for p in best:
        if len(kept) < keep and (p["chapter"] in titles or all(k["chapter"] != p["chapter"] for k in kept)):
            kept.append(p)
    for t in sorted(titles, key=lambda t: (-len(t), titles.index(t)))[:3]:
        own = [p for p in best if p["chapter"] == t]
        if own and all(k["chapter"] != t for k in kept):
            kept.append(next((p for p in own if any(s in p["text"] for s in symbols)), own[0]))
    return [p["id"] for p in kept]


def test_cap_and_pin_like_a_greedy_loop(spark):
    r = random.Random(11)
    pools, titled, asked, want = [], [], [], {}
    for q in range(120):
        names = ["A", "Bb", "Ccc", "Dddd", "Ee", "Ffffff", "G"]
        pool = [{"qid": q, "id": f"{q}-{i}", "pos": i, "chapter": r.choice(names), "score": float(r.randint(-7, 5)), "text": r.choice(["a_b here", "plain"])} for i in range(r.randint(0, 16))]
        titles = r.sample(names, r.randint(0, 4))
        question = r.choice(["what of a_b", "what"])
        pools += pool
        titled += [(q, t, titles.index(t)) for t in titles]
        asked.append((q, question))
        want[q] = _greedy(pool, titles, ["a_b"] if "a_b" in question else [])
    df = spark.createDataFrame(pools, "qid int, id string, pos int, chapter string, score double, text string")
    got = {q: [] for q in want}
    for x in ranking.rank_and_pin(df, spark.createDataFrame(titled, "qid int, chapter string, chapter_pos int"), spark.createDataFrame(asked, "qid int, question string")).orderBy("qid", "kept_rank").collect():
        got[x.qid].append(x.id)
    assert got == want


def test_knn_is_exact_over_blocks(spark):
    r = random.Random(1)
    rows = [(i, [r.random() for _ in range(5)]) for i in range(90)] + [(90, None), (91, [])]
    df = spark.createDataFrame(rows, "id bigint, vector array<double>")
    got = knn.nearest(df.withColumnRenamed("id", "qid"), df, 3, block=20, not_self=True).collect()
    dist = lambda a, b: round(sum((x - y) ** 2 for x, y in zip(rows[a][1], rows[b][1])), 6)
    want = {(a, b, k + 1) for a in range(90) for k, b in enumerate(sorted((b for b in range(90) if b != a), key=lambda b: (dist(a, b), b))[:3])}
    assert {(x.qid, x.id, x["rank"]) for x in got} == want
    assert col(spark, [3.0, 4.0], V.norm, "array<double>") == 5.0


def test_ordinal(spark):
    ids = random.Random(2).sample(range(5000), 700)
    got = with_ordinal(spark.createDataFrame([(i,) for i in ids], "x int").repartition(5), ["x"], "n").collect()
    assert {r.x: r.n for r in got} == {x: n for n, x in enumerate(sorted(ids))}


def _chapters(spark):
    rows = [("Timer", 0, "Timer counts down. Its wait_time is in seconds. " * 3), ("Sprite2D", 1, "Sprite2D is a node that draws a picture, with a texture."), ("Lights and shadows", 2, "Shadows need lights. Lights cast shadows over scenes.")]
    return spark.createDataFrame([(t, "", o, x) for t, o, x in rows], "title string, href string, order bigint, text string")


def test_retrieve_and_answer(spark):
    chunks = chunk_chapters(_chapters(spark))
    q = spark.createDataFrame([(1, " what is sprite2d "), (2, "how do lights cast shadows"), (3, "zebra quantum"), (4, "  "), (5, None)], "qid int, question string")
    calls = []

    def expand(df):
        calls.append({r.qid for r in df.collect()})
        return df.withColumn("expansion", F.when(F.col("qid") == 2, "Timer, x").otherwise(""))

    d = R.retrieve(q, chunks, Providers(expand=expand))
    assert calls == [{2, 3}]
    assert {r.qid: r.query for r in d.texts.collect()} == {1: "what is sprite2d", 2: "how do lights cast shadows Timer, x", 3: "zebra quantum"}
    kept = {(r.qid, r.chapter) for r in d.kept.collect()}
    assert (1, "Sprite2D") in kept and (2, "Lights and shadows") in kept and not any(k == 3 for k, _ in kept)
    got = {r.qid: r for r in R.answers(q, d.kept).collect()}
    assert got[1].found and got[1].sources[0].chapter == "Sprite2D" and got[1].message is None
    assert not got[3].found and got[3].answer is None and got[3].message == A.NOT_FOUND and set(got) == {1, 2, 3}
    refused = R.answers(q, d.kept, Providers(answer=lambda df: df.withColumn("answer", F.lit(A.NOT_FOUND + " Sorry"))))
    assert not any(r.found for r in refused.collect())
    assert {r.qid for r in R.vector_only(q, chunks).collect()} <= {1, 2}


def test_bm25_and_long_tokens(spark):
    chunks = spark.createDataFrame([("a", "rare word word"), ("b", "word"), ("c", "y" * 41), ("d", None)], "id string, text string")
    q = spark.createDataFrame([(1, "rare word"), (2, "y" * 41)], "qid int, question string")
    got = [(r.qid, r.id, r["rank"]) for r in bm25.search(chunks, q, 5).orderBy("qid", "rank").collect()]
    assert got == [(1, "a", 1), (1, "b", 2)]
    assert bm25.postings(chunks).count() == 3


def test_ingest_and_store(spark, tmp_path):
    assert ingest(_chapters(spark), str(tmp_path / "db"))["rows"] == 3
    t = store.open_table(spark, str(tmp_path / "db"))
    assert t.columns == ["id", "vector", "text", "chapter", "order"] and len(t.first().vector) == 64
    assert ingest(_chapters(spark), str(tmp_path / "db"), max_chunks=2)["rows"] == 2
    store.write_json(store.open_table(spark, str(tmp_path / "db")).select("id"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_pages_and_epub(spark, tmp_path):
    body = "<p>" + "long enough text " * 5 + "</p>"
    p = spark.createDataFrame([(3, "u3", f"<h1>T</h1>{body}", ""), (1, "u1", body, None), (2, "u2", "<p>tiny</p>", "x")], "page_id bigint, url string, html string, title string")
    assert [(r.title, r.href, r.order) for r in pages.chapters_from_pages(p).orderBy("order").collect()] == [("u1", "u1", 0), ("", "u3", 1)]
    assert [r.title for r in pages.chapters_from_pages(p.drop("title")).orderBy("order").collect()] == ["u1", "T"]
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        f.writestr("O/c.opf", '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/><item id="n" href="t.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine><itemref idref="b"/><itemref idref="zz"/><itemref idref="a"/></spine></package>')
        f.writestr("O/t.ncx", '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>Bee</text></navLabel><content src="b.xhtml#x"/></navPoint></navMap></ncx>')
        f.writestr("O/a.xhtml", f"<h1>Ay</h1>{body}")
        f.writestr("O/b.xhtml", body)
    (tmp_path / "x.epub").write_bytes(z.getvalue())
    assert [(r.title, r.href, r.order) for r in epub.read_epub(spark, str(tmp_path)).orderBy("order").collect()] == [("Bee", "O/b.xhtml", 0), ("Ay", "O/a.xhtml", 1)]


def test_options(monkeypatch):
    options.reset()
    monkeypatch.delenv("XDG_CACHE_HOME", raising=False)
    assert options.default_cache_dir("linux", "/h/u") == "/h/u/.cache/passagemill" and options.default_cache_dir("darwin", "/h/u").endswith("Library/Caches/passagemill")
    assert options.configure(cache_dir="/tmp/c", llm_base_url="https://x.test/v1/").llm_base_url == "https://x.test/v1"
    for bad, error in (({"cache_dir": "rel"}, ValueError), ({"llm_base_url": "file:///x"}, ValueError), ({"llm_model": " "}, ValueError), ({"nope": 1}, TypeError), ({"llm_model": 3}, TypeError)):
        with pytest.raises(error):
            options.configure(**bad)
    assert options.get_options().cache_dir == "/tmp/c"
    monkeypatch.setenv("PASSAGEMILL_ALLOW_MODEL_DOWNLOADS", "maybe")
    with pytest.raises(ValueError):
        options.get_options()
    options.reset()
