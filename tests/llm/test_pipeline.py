"""The pipeline on a small fixture: each stage against a plain version of its decision, on that stage's own input."""

import random

import corpus_pipeline
from passagemill.llm import decontaminate


def _words(seed, n, letters):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(n)]


def test_pipeline(spark, tmp_path):
    letters = {"en": "abcdefgho", "de": "mnopqrstu"}
    rows = []
    for i in range(160):
        lang = ("en", "de")[i % 2]
        rows.append([i, " ".join(_words(i, 120, letters[lang])), lang])
    rows[10][1] = rows[2][1]
    rows[12][1] = rows[2][1] + " extra"
    item = " ".join(_words(999, 30, letters["en"]))
    rows[20][1] = rows[20][1][:200] + " " + item + " " + rows[20][1][200:]
    rows[30][1] += " password=abc123def456"
    rows += [[300, "123 ...", "en"], [301, "", "en"], [302, None, "en"]]
    d = str(tmp_path)
    spark.createDataFrame([(i, t, k, "s", len(t or "")) for i, t, k in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        out.write.parquet(f"{d}/stage{k}")
        docs = spark.read.parquet(f"{d}/stage{k}")
        seen[name] = docs.toPandas()
        if name != "mixing":
            assert docs.columns == columns
    ids = {k: set(v.doc_id) for k, v in seen.items()}
    every = {r[0] for r in rows}
    assert ids["language_id"] == every - {300, 301, 302}
    assert ids["simhash_dedup"] == ids["language_id"] - {10, 12}
    assert ids["decontaminate"] == ids["simhash_dedup"] - {20}
    assert ids["secret_scan"] == ids["decontaminate"]
    t = seen["secret_scan"].set_index("doc_id")
    assert t.text[30].endswith("[SECRET]") and t.n_chars[30] == len(t.text[30]) and t.text[31] == rows[31][1]
    m = seen["mixing"]
    assert set(m.doc_id) <= ids["secret_scan"] and set(m.mix_source) <= {"lang:en", "lang:de", "long"} and (m.copies > 0).all()
    assert sorted(map(tuple, corpus_pipeline.run(spark, d).collect())) == sorted(m.itertuples(index=False, name=None))
    assert decontaminate.THRESHOLD < 1 and [n for n, _ in corpus_pipeline.STAGES][0] == "language_id"


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _spans string, row string, takes int"


def _corpus(spark, folder, rows, item):
    spark.createDataFrame([(i, t, k, "s", len(t or ""), "mine", "r", 7) for i, t, k in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, item)] if item else [], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_decisions_show_in_the_result(spark, tmp_path):
    letters = {"en": "abcdefgho", "de": "mnopqrstu"}
    rows = [[i, " ".join(_words(i, 120, letters[("en", "de")[i % 2]])), ("en", "de")[i % 2]] for i in range(80)]
    item = " ".join(_words(999, 30, letters["en"]))
    secret = "password=" + "aB3" * 40_000
    for i in range(0, 20, 2):  # English without a label, each with a secret
        rows[i][1:] = rows[i][1] + " " + secret, None
    rows[21][1] = " ".join(_words(5000, 90_000, letters["de"]))
    rows[23][1] = " ".join(_words(5001, 90_000, letters["de"])) + " " + item
    rows += [[200, "12 !", None], [None, rows[1][1], "de"], [201, rows[21][1], "de"]]
    _corpus(spark, str(tmp_path), rows, item)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")] + ["mix_source", "copies", "n_tokens"]
    got = got.collect()
    text = {i: t for i, t, _ in rows}
    assert got and all(r._spans == "mine" and r.row == "r" and r.takes == 7 for r in got)
    assert not {200, 201, 23, None} & {r.doc_id for r in got}
    for r in got:  # the masked text leaves, and a document without a label counts as its language's
        want = text[r.doc_id].replace(secret, "[SECRET]")
        assert r.text == want and r.n_chars == len(want) and r.n_tokens == len(want.split()) and r.copies > 0
        assert r.lang == ("en", "de")[r.doc_id % 2] and r.mix_source in (f"lang:{r.lang}", "long")
    assert any(r.text.endswith("[SECRET]") and r.mix_source == "lang:en" for r in got)
    one = corpus_pipeline.near_copies(spark, spark.read.parquet(f"{tmp_path}/documents.parquet").where("doc_id in (21, 201, 3)"), str(tmp_path))
    assert {r.doc_id: r.text for r in one.collect()} == {i: text[i] for i in (21, 3)}


def test_an_empty_table_gives_no_rows(spark, tmp_path):
    _corpus(spark, str(tmp_path), [], None)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
