"""Long texts, clashing names, hot groups and brute force for what tests/llm/test_operators.py leaves open."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import pytest

from passagemill.llm import chat_format, decontaminate, embedding_dedup, language_crf, mixing, ppm_score, secrets_scan, shared, simhash_dedup, textnum, url_filter


def prose(seed, n, letters="abcdefgh"):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(n)]


def table(spark, rows, more="source string"):
    return spark.createDataFrame([(i, t, lang, "s") for i, t, lang in rows], f"doc_id bigint, text string, lang string, {more}")


LONG = " ".join(prose(1, 60_000))


# 1


def _spelled(turns):
    """Ids and mask, token by token."""
    enc, (bos, start, end) = chat_format.encoding()
    ids, mask = [bos], [0]
    for role, text in turns:
        name = chat_format.escape_role("unknown" if role is None else role)
        for t in [start, *enc.encode_ordinary(name), *enc.encode_ordinary("\n")]:
            ids.append(t)
            mask.append(0)
        for t in [*enc.encode_ordinary(chat_format.escape(text or "")), end]:
            ids.append(t)
            mask.append(int(role == "assistant"))
        for t in enc.encode_ordinary("\n"):
            ids.append(t)
            mask.append(0)
    return ids, mask


def test_chat_is_that_of_a_loop_over_tokens():
    r = random.Random(3)
    roles, signs = ["user", "assistant", None, "a\nb", "x\\n\\", "<|end|>\n", ""], ["<|start|>", "<\\|end|>", "\n", "word ", "é日", "\\", "|>", " "]
    for _ in range(60):
        turns = [(r.choice(roles), r.choice([None, "", "".join(r.choice(signs) for _ in range(r.randint(1, 12)))])) for _ in range(r.randint(1, 5))]
        ids, mask = chat_format.assemble(turns)
        assert (ids.tolist(), mask.tolist()) == _spelled(turns)
        assert chat_format.parse(ids.tolist()) == [("unknown" if a is None else a, b or "") for a, b in turns]


def test_long_conversations_come_in_parts(spark):
    rows = [(1, i // 2, ("user", "assistant")[i % 2], f"turn {i}") for i in range(101)] + [(1, None, None, "first")] + [(2, 0, "user", LONG), (2, 1, "assistant", "ok")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    parts = sorted(chat_format.format_chats(df, part_turns=10).collect(), key=lambda r: (r.conv_id, r.part))
    whole = {r.conv_id: r for r in chat_format.format_chats(df).collect()}
    assert len(whole) == 2 and len(parts) > 8 and max(r.n_turns for r in parts) <= 12
    for c, one in whole.items():
        mine = [r for r in parts if r.conv_id == c]
        assert [x for r in mine for x in r.input_ids] == one.input_ids and [x for r in mine for x in r.loss_mask] == one.loss_mask
        assert [r.part for r in mine] == list(range(len(mine))) and sum(r.n_turns for r in mine) == one.n_turns
    assert chat_format.parse(whole[2].input_ids) == [("user", LONG), ("assistant", "ok")]


# 2


def test_rules_may_be_a_table(spark):
    rules = [(0, r"//spam\.", "a"), (1, r"[?&]q=[0-9]+", "b"), (1, r"[?&]q=[0-9]+", "b"), (None, "x", "n"), (3, None, "n"), (4, r"^$", "empty")]
    urls = ["http://spam.example/?q=12", "", None, "http://x/" + "y" * 200_000 + "/?q=1", "http://spam.example/?q=12"]
    pages = spark.createDataFrame([(i, u, 1, "t") for i, u in enumerate(urls)], "page_id bigint, url string, rule_id int, token string")
    t = spark.createDataFrame(rules, "rule_id int, pattern string, action string")
    want = {(i, k) for i, u in enumerate(urls) if u is not None for k, p, _ in rules if k is not None and p is not None and re.search(p, u, re.I)}
    got = url_filter.match(pages, t).collect()
    assert {(r.page_id, r.rule_id) for r in got} == want and len(got) == len(want)
    assert url_filter.match(pages, t.where("false")).count() == 0
    with pytest.raises(Exception, match="unterminated|missing|PythonException|error"):
        url_filter.match(pages, [(0, "(", "bad")]).count()


# 3


def _leaks(docs, items):
    """Every window of every document scored against every item, weight by weight."""
    split = {i: re.findall(r"\w+", t.lower()) for i, t in items}
    n, mean = len(items), sum(map(len, split.values())) / len(items)
    df = Counter(w for ws in split.values() for w in set(ws))
    out = {}
    for item, text in items:
        tf = Counter(split[item])
        weight = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(split[item]) / mean)) for w, c in tf.items()}
        total = sum(weight.values())
        at = decontaminate.answer_at(text.lower())
        halves = [re.findall(r"\w+", x) for x in (text.lower()[:at], text.lower()[at:])]
        size = decontaminate.window_cells(len(split[item])) * decontaminate.STRIDE
        grams = lambda ws, n: {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}
        for d, body in docs:
            words = re.findall(r"\w+", body.lower())
            for a in range(0, max(1, len(words)), decontaminate.STRIDE):
                have = words[a : a + size]
                score = sum(w for k, w in weight.items() if k in set(have)) / total
                if score >= decontaminate.THRESHOLD - 1e-9:
                    shares = [len(grams(h, min(3, len(h))) & grams(have, min(3, len(h)))) / len(grams(h, min(3, len(h)))) for h in halves]
                    if min(shares) >= decontaminate.OVERLAP:
                        out[d, item] = max(out.get((d, item), (0, 0, 0)), (score, *shares))
    return out


def test_an_items_hits_do_not_depend_on_other_items_or_shards(spark):
    items = [(0, " ".join(prose(50, 6))), (1, " ".join(prose(51, 40))), (2, " ".join(prose(52, 3000))), (3, " ".join(prose(53, 41)))]
    scattered = prose(60, 900)
    for k, w in enumerate(prose(50, 6)):
        scattered[k * 90 + 40] = w  # the short item's words, far apart
    docs = [(i, " ".join(prose(70 + i, 200) + items[i][1].split() + prose(80 + i, 77 * i))) for i in range(4)]
    docs += [(10, " ".join(scattered)), (11, " ".join(items[2][1].split()[:2400])), (12, " ".join(items[1][1].split()[:20] + prose(90, 3) + items[1][1].split()[20:])), (13, LONG[:40_000] + " " + items[3][1])]
    want = _leaks(docs, items)
    assert {(0, 0), (1, 1), (2, 2), (3, 3), (13, 3)} <= set(want) and (10, 0) not in want
    d, b = table(spark, [(i, t, "en") for i, t in docs]), spark.createDataFrame(items, "item_id bigint, text string")
    for size in (8 << 20, 400):
        got = {(r.doc_id, r.item_id): (r.score, r.question_overlap, r.answer_overlap) for r in decontaminate.leaks(d, b, shard_bytes=size).collect()}
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


# 4


def test_cells_searched_and_vectors_of_any_size(spark):
    r = np.random.default_rng(4)
    v = r.normal(size=(260, 24)).astype(np.float32)
    v[100:160] = v[0] + r.normal(size=(60, 24)) * 0.08
    v[200:230] = v[1]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    root = {}
    for a, b in zip(*embedding_dedup.reached(v, 0.95, block=7)):
        root[a] = b
    near = v @ v.T >= 0.95
    seen, groups = set(), []
    for i in range(len(v)):
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                for j in np.flatnonzero(near[todo.pop()]).tolist():
                    if j not in group:
                        group.add(j)
                        todo.append(j)
            seen |= group
            groups.append(group)
    by = defaultdict(set)
    for a in range(len(v)):
        by[root.get(a, a)].add(a)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, groups))
    rows = [(0, [1e30, 0.0, 1e30]), (1, [1e-30, 0.0, 1e-30]), (2, [0.0, 1e-20, 0.0]), (3, [0.0, 1e20, 0.0]), (4, [1.0, 1.0, -1.0]), (5, None), (None, [1.0, 0.0, 1.0]), (6, [float("inf"), 0.0, 0.0])]
    df = spark.createDataFrame([(i, e, 7) for i, e in rows], "vec_id bigint, embedding array<float>, _drop_id int")
    assert {(x.vec_id, x.group_id) for x in embedding_dedup.groups(df).collect()} == {(0, 0), (1, 0), (2, 2), (3, 2)}
    left = embedding_dedup.dedup(df)
    assert left.columns == df.columns and sorted(x.vec_id for x in left.collect() if x.vec_id is not None) == [0, 2, 4, 5, 6] and left.count() == 6


def test_borders_lose_no_planted_pair(spark):
    r = np.random.default_rng(9)
    v = r.normal(size=(900, 64))
    v[600:] = v[:300] + r.normal(size=(300, 64)) * 0.18
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    links = sum(float(v[i] @ v[600 + i]) >= 0.95 for i in range(300))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<float>")
    home = {x.vec_id: x.group_id for x in embedding_dedup.groups(df).collect()}
    found = sum(home.get(i, -1) == home.get(600 + i, -2) for i in range(300) if float(v[i] @ v[600 + i]) >= 0.95)
    assert links > 200 and found >= 0.99 * links


# 5


def _mixed(rows, weights, budget, epochs):
    """Copies of every document, one pass over each pattern's tokens after another."""
    total = sum(n for *_, n in rows)
    unit = sum(weights.values())
    quotas = {x: int(total * budget * w / unit) for x, w in weights.items()}
    by = defaultdict(list)
    for h, i, sources, n in rows:
        p = tuple(sorted(set(sources) & set(weights)))
        if p and n:
            by[p].append((h % 1024, h, i, n))
    pats = sorted(by, key="\x1f".join)
    given, _ = mixing.route([(p, sum(x[-1] for x in by[p])) for p in pats], quotas, epochs)
    out = Counter()
    for p, g in zip(pats, given):
        at, size = 0, sum(x[-1] for x in by[p])
        ends = []
        for x in sorted(g):
            ends.append((x, at, at + g[x]))
            at += g[x]
        for r in range(epochs):
            start = r * size
            for *_, i, n in sorted(by[p]):
                for x, lo, hi in ends:
                    out[i, x] += lo <= start + n // 2 < hi
                start += n
    return {k: c for k, c in out.items() if c}


@pytest.mark.parametrize("budget", [0.3, 1.4])
def test_mixed_documents_are_those_of_a_loop(spark, budget):
    r = random.Random(8)
    rows = [(i, " ".join(["w"] * r.randint(1, 40)), r.choice(["en", "de", None, "xx"])) for i in range(400)] + [(900, LONG, "de")]
    weights = {"en": 0.5, "de": 0.3, "odd": 0.2}
    members = F.array_compact(F.array(F.col("lang"), F.when(F.col("doc_id") % 2 == 1, F.lit("odd"))))
    df = table(spark, rows, "row string").withColumnRenamed("row", "takes").withColumn("pattern", F.lit("mine"))
    h = {x.doc_id: x.h for x in df.select("doc_id", F.xxhash64(F.lit(42), "doc_id").alias("h")).collect()}
    want = _mixed([(h[i], i, [s for s in (lang, "odd" if i % 2 else None) if s], len(t.split())) for i, t, lang in rows], weights, budget, 4)
    got = mixing.mix(df, members, weights, budget).collect()
    assert {(x.doc_id, x.mix_source): x.copies for x in got} == want and len(got) == len(want) > 100
    whole = mixing.mixed_rows(df, members, weights, budget)
    assert whole.columns == [*df.columns, "mix_source", "copies", "n_tokens"]
    text = {i: t for i, t, _ in rows}
    assert {(x.doc_id, x.mix_source): x.copies for x in whole.collect()} == want and all(x.text == text[x.doc_id] and x.pattern == "mine" for x in whole.collect())
    with pytest.raises(ValueError):
        mixing.mixed_rows(df.withColumn("copies", F.lit(1)), members, weights)


def test_mixing_rows_of_one_id_and_many_patterns(spark):
    df = table(spark, [(7, "a b c", "en")] * 300 + [(i, "a b", "en") for i in range(1000, 1100)])
    got = mixing.mix(df, F.array("lang"), {"en": 1.0}, budget=0.5).collect()
    ids = Counter(x.doc_id for x in got)
    assert ids[7] in (0, 300) and sum(x.copies * x.n_tokens for x in got) > 0
    r = random.Random(1)
    names = [f"s{i}" for i in range(14)]
    patterns = {tuple(sorted(r.sample(names, r.randint(1, 14)))): r.randint(1, 10**6) for _ in range(20_000)}
    total = sum(patterns.values())
    quotas = {x: int(total * r.random() / 6) for x in names}
    given, _ = mixing.route(list(patterns.items()), quotas)
    assert Counter({x: sum(g.get(x, 0) for g in given) for x in names}) == Counter(quotas)


# 6


def test_large_blocks_have_the_components_of_all_pairs():
    r = np.random.default_rng(2)
    for flips in (6, 14, 30):
        bits = np.repeat(r.random((3, 128)) < 0.5, 60, axis=0)
        for _ in range(flips):
            at = r.integers(0, 128, len(bits))
            bits[np.arange(len(bits)), at] ^= True
        fp = np.packbits(bits, axis=1).view(np.int64)
        a, b, _ = simhash_dedup.block_pairs(np.zeros(len(fp), np.int64), fp, 20)
        roots = lambda x, y: set(zip(*(z.tolist() for z in simhash_dedup.local_roots(x, y))))
        assert roots(*simhash_dedup.reached(fp, 20)) == roots(a, b)


def test_linked_blocks_have_the_components_of_all_pairs():
    r = np.random.default_rng(4)
    bits = np.repeat(r.random((80, 128)) < 0.5, 4, axis=0)
    at = np.argsort(r.random(bits.shape), axis=1)[:, :10]
    np.put_along_axis(bits, at, ~np.take_along_axis(bits, at, axis=1), axis=1)
    fp = np.packbits(bits, axis=1).view(np.int64)
    a, b, _ = simhash_dedup.block_pairs(np.zeros(len(fp), np.int64), fp, 20)
    roots = lambda x, y: set(zip(*(z.tolist() for z in simhash_dedup.local_roots(x, y))))
    near = simhash_dedup.pivot_table(fp, 16)
    for dense, cells in ((16, 1 << 16), (16, 100), (16, 5000), (0, 5000)):  # in one tile, row by row, in tiles, by search
        assert roots(*simhash_dedup.linked(fp, near, 20, dense, cells)) == roots(a, b)
    assert len(a) > 100


def test_compare_puts_keys_together_over_batches():
    r = np.random.default_rng(3)
    base = r.integers(-(2**62), 2**62, (4, 2), dtype=np.int64)
    key = np.repeat([1, 2, 2, 3, 5], 20)
    fp = base[np.repeat([0, 1, 1, 2, 3], 20)] ^ (np.int64(1) << r.integers(0, 60, (100, 2)))
    cols = [pa.array(x) for x in (key, np.arange(100), fp[:, 0], fp[:, 1])]
    whole = pa.RecordBatch.from_arrays(cols, ["key", "doc_id", "f0", "f1"])
    edges = lambda step, large: {(a, b) for out in simhash_dedup._compare(20, large)(whole.slice(i, step) for i in range(0, 100, step)) for a, b in zip(*(c.to_pylist() for c in out.columns))}
    want = {(i, 0) for i in range(1, 20)} | {(i, 20) for i in range(21, 60)} | {(i, 60) for i in range(61, 80)} | {(i, 80) for i in range(81, 100)}
    assert edges(100, 4096) == edges(7, 4096) == edges(1, 4096) == edges(13, 5) == want


def test_very_long_texts_have_fingerprints_and_scores(spark):
    df = table(spark, [(1, LONG, "en"), (2, LONG + " more", "en"), (3, "short text of its own", "en")])
    assert {(r.doc_id, r.group_id) for r in simhash_dedup.groups(df).collect()} == {(1, 1), (2, 1)}
    got = {r.doc_id: r for r in ppm_score.score(df).collect()}
    assert got[1].n_bytes == len(LONG) and 0 < got[1].bits_per_byte < 8 and got[3].bits > 0


# 9


def test_no_column_name_clashes_with_masking(spark):
    rows = [(1, "x password=abc123def456 y", "en"), (2, "clean", "en"), (None, None, "en")]
    df = table(spark, rows)
    for c in ("_spans", "_id", "_key", "_text_key", "spans", "key", "id", "row", "x", "masked", "d", "s"):
        df = df.withColumn(c, F.lit(f"kept {c}"))
    out = secrets_scan.redact(df)
    assert out.columns == df.columns and out.schema["text"].dataType == df.schema["text"].dataType
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == "x [SECRET] y" and got[2].text == "clean" and got[None].text is None
    assert all(getattr(r, c) == f"kept {c}" for r in got.values() for c in ("_spans", "_id", "_key", "_text_key", "row", "x"))


def test_a_very_long_secret_is_masked_whole(spark):
    texts = ["token=" + "aB3" * 33_334, LONG[:100_000] + " password=abc123def456 " + LONG[:100_000], "see 10.0.0.1 " + "k9" * 50_000]
    got = [r.text for r in secrets_scan.redact(table(spark, [(i, t, "en") for i, t in enumerate(texts)])).orderBy("doc_id").collect()]
    assert got == ["[SECRET]", LONG[:100_000] + " [SECRET] " + LONG[:100_000], "see [SECRET] [SECRET]"]


@pytest.mark.parametrize("text", ["pwd = 12345678", "'api_key':\t\"abcdefgh\"", "x_password=abcdefgh", "a://u:p@h", "AKIA" + "Z" * 16, "-----BEGIN PRIVATE KEY-----\nAAAABBBBCCCCDDDD", "_" + "a1" * 16, "é" + "a1" * 16, "+" + "a1" * 16 + " at 10.0.0.1", "xoxb-12345-67890", "rk_live_" + "a1" * 9, "glpat-" + "a1" * 10])
def test_what_may_be_reported_is_looked_at(text):
    assert re.search("|".join((secrets_scan.KEY_ID, secrets_scan.PREFIXED, secrets_scan.ASSIGNED, secrets_scan.RUN, secrets_scan.PEM, f"://{secrets_scan.LOGIN}@")), text)


# 10


def test_emissions_are_those_of_a_loop_over_features():
    model = language_crf.train([("a", "Foo bar ab c barbar bar"), ("b", "quux quilt qu bar z quux"), ("a", "foo foo ab")])
    text = "foo quux ab zz é barbar x".encode()
    buf = np.frombuffer(text, np.uint8)
    s, e, _ = language_crf.letter_words(buf, np.array([0, len(buf)]))
    got = language_crf.emissions(model, buf, s, e, textnum.span_hash(buf, s, e))
    place = lambda code, kind: int(textnum.mix(np.array([code], np.uint64), kind)[0] % np.uint64(language_crf.BUCKETS))
    number = lambda b: sum(x * 257 ** (len(b) - 1 - i) for i, x in enumerate(b))
    lexicon = {int(h): row for h, row in zip(model.lexicon, model.lexicon_in)}
    assert lexicon
    for w, (a, b) in enumerate(zip(s, e)):
        word = text[a:b]
        at = [place(number(word[:k]), k) for k in (1, 2, 3) if len(word) >= k] + [place(number(word[-k:]), 10 + k) for k in (1, 2, 3) if len(word) >= k]
        at += [place(number(word[i : i + k]), 20 + k) for k in (2, 3) for i in range(len(word) - k + 1)]
        want = model.weights[-1] + sum(model.weights[i] for i in at)
        known = lexicon.get(textnum.word_hash(word))
        if known is not None:
            want = want + known @ model.weights[language_crf.BUCKETS : language_crf.BUCKETS + len(model.languages)]
        assert got[w] == pytest.approx(want, rel=1e-4, abs=1e-5)


def test_the_sample_has_the_least_hashes(spark, monkeypatch):
    rows = [(i, " ".join(prose(i, 5)), "xx") for i in range(60)] + [(5, "again", "xx"), (None, "no id", "xx"), (61, None, "xx"), (62, "no lang", None)]
    df = table(spark, rows)
    h = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64(F.lit(42), "doc_id").alias("h")).collect()}
    seen = []
    monkeypatch.setattr(language_crf, "train", seen.append)
    language_crf.fit(df, sample_rows=10)
    want = sorted((h[i], lang, t) for i, t, lang in rows if i is not None and t is not None and lang is not None)[:10]
    assert seen == [[(lang, t) for _, lang, t in want]]


def test_rows_without_a_language_get_theirs(spark):
    alphabet = {"xx": "abcdeo", "yy": "mnopqu"}
    rows = [(i, " ".join(prose(i, 60, alphabet[k])), k) for i, k in enumerate(list(alphabet) * 40)]
    model = language_crf.train([(k, t) for _, t, k in rows])
    odd = [(900, rows[0][1], None), (901, rows[1][1], None), (902, rows[0][1], "yy"), (903, None, None), (904, " ".join(prose(5, 40_000, "abcdeo")), None)]
    got = {r.doc_id: r.lang for r in language_crf.keep_identified(table(spark, odd), model).collect()}
    assert got == {900: "xx", 901: "yy", 902: "yy", 904: "xx"}


# shared


def test_the_shared_folder_must_be_named_on_a_cluster():
    none = type("C", (), {"get": staticmethod(lambda *a: None)})
    session = lambda master: type("X", (), {"conf": none, "sparkContext": type("S", (), {"master": master, "getConf": staticmethod(lambda: none)})})
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared.shared_dir(session(master))


def test_broadcasts_are_marked_by_bytes(spark):
    df = spark.createDataFrame([("x" * 100,)] * 10, "t string")
    plan = lambda d: d._jdf.queryExecution().logical().toString()
    assert "Hint" in plan(shared.small(df, F.octet_length("t"), 1000)) and "Hint" not in plan(shared.small(df, F.octet_length("t"), 999))
    assert "Hint" in plan(shared.small(df.where("false"), F.octet_length("t"), 0))
