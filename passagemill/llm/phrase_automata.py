"""Operator 8: substring dedup by repeated-phrase automata.

A recurring passage is a run of at least WORDS white-space words that occurs, word for word, in
two documents or more.  Winnowing picks anchors (the runs of half that length with the least
hash in each window), so that every occurrence of a recurring passage holds an anchor which the
other occurrences hold too.  Around anchors that several documents share, the text as far as a
passage of WORDS words can reach is cut out; shard by shard of anchors, passages are confirmed
word for word, compiled into an Aho-Corasick automaton, and every document's cut-outs are
streamed through it.  What it finds, in all documents, joins up to spans.

A short passage in very many documents gives its anchors as many different cut-outs.  Those of an
anchor with more than HOT of them are not brought together: the runs of WORDS words around it are
rows, by two hashes of 64 bits each, pre-aggregated to the least and greatest doc_id that
holds them, and those of two documents are the spans.  The result is the same.

The result has every span of every document that recurring passages cover.

Defined results: null and empty texts and those under WORDS words hold no passage; a null
doc_id has no identity and is left out; rows repeated under one doc_id do not make a passage
recur, and their spans are merged if their texts are equal; a repetition within one document
alone is not one; texts of any length are read whole; an empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

import math

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import textnum as tn
from .shared import small, written

WORDS = 50
SHARD_CONTEXTS = 4000
HOT = 2000
_PLACE = 26  # bits of a word's place in the packed key of an anchor


def anchors_of(buf: np.ndarray, off: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word of the row where it begins, hash) of each anchor; every window of so many words has one, by its words alone."""
    s, e, row = tn.tokens(buf, off, tn.INK)
    half = words // 2
    if len(s) < words:
        z = np.zeros(0, np.int64)
        return z, z, z
    h = tn.span_hash(buf, s, e)
    at = np.arange(len(h) - half + 1)
    run = tn.span_hash(h, at, at + half)
    key = ((run >> np.uint64(_PLACE)) << np.uint64(_PLACE)) | at.astype(np.uint64)
    key[row[at] != row[at + half - 1]] = np.uint64((1 << 64) - 1)
    low = tn.window_min(key, words - half + 1)
    whole = row[: len(low)] == row[words - 1 : words - 1 + len(low)]
    low = low[whole]
    if len(low):
        low = low[np.r_[True, low[1:] != low[:-1]]]
    pos = (low & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    first = np.searchsorted(row, np.arange(len(off)))
    return row[pos], pos - first[row[pos]], run[pos].view(np.int64)


def _anchors(words: int):
    def run(batches):
        for b in batches:
            ids, text_key = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo, _, buf, off in tn.slices(tn.column(b, "text")):
                row, pos, fp = anchors_of(buf, off, words)
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(ids[lo + row]), pa.array(text_key[lo + row]), pa.array(pos.astype(np.int32))], ["fp", "doc_id", "text_key", "pos"])

    return run


def _windows(words: int):
    """Of each context, the runs of so many words that hold its anchor, by two hashes."""
    half = words // 2

    def run(batches):
        for b in batches:
            fp, key, anchor, low, high = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            for lo, hi, buf, off in tn.slices(tn.column(b, "ctx")):
                s, e, row = tn.tokens(buf, off, tn.INK)
                first = np.searchsorted(row, np.arange(hi - lo + 1))
                n, at = np.diff(first), anchor[lo:hi].astype(np.int64)
                begin, last = np.maximum(0, at + half - words), np.minimum(at, n - words)
                many = np.maximum(last - begin + 1, 0)
                r = np.repeat(np.arange(hi - lo), many)
                w = np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many) + begin[r]
                if not len(r):
                    continue
                x = first[r] + w
                h0 = tn.span_hash(buf, s[x], e[x + words - 1])
                h1 = tn.span_hash(tn.span_hash(buf, s, e), x, x + words)
                r += lo
                cols = [fp[r], key[r], anchor[r], w.astype(np.int32), h0.view(np.int64), h1.view(np.int64), low[r], high[r]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["fp", "ctx_key", "anchor", "a", "h0", "h1", "low", "high"])

    return run


def hot_hits(one: DataFrame, words: int) -> DataFrame:
    """(fp, ctx_key, anchor, a, b) of the runs that two documents hold, of any number of contexts of an anchor."""
    w = one.select("fp", "ctx_key", "anchor", "low", "high", "ctx").mapInArrow(_windows(words), "fp bigint, ctx_key bigint, anchor int, a int, h0 bigint, h1 bigint, low bigint, high bigint")
    shared = w.groupBy("fp", "h0", "h1").agg(F.min("low").alias("x"), F.max("high").alias("y")).where("x <> y").select("fp", "h0", "h1")
    found = w.join(small(written(shared, "hot-runs"), 48), ["fp", "h0", "h1"], "left_semi")
    return found.select("fp", "ctx_key", "anchor", "a", (F.col("a") + words).cast("int").alias("b"))


def _contexts(words: int):
    half = words // 2

    def run(batches):
        for b in batches:
            texts = tn.column(b, "text")
            ids, keys, found = b.column(0), b.column(1), b.column(3)
            fps, docs, text_keys, firsts, offs, ctx = [], [], [], [], [], []
            for i in range(b.num_rows):
                w = texts[i].as_py().encode().split()
                for x in found[i].as_py():
                    a = max(0, x["pos"] - half)
                    fps.append(x["fp"])
                    docs.append(ids[i].as_py())
                    text_keys.append(keys[i].as_py())
                    firsts.append(a)
                    offs.append(x["pos"] - a)
                    ctx.append(b" ".join(w[a : x["pos"] + words]).decode())
                if len(ctx) > 2000 or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(fps, pa.int64()), pa.array(docs, pa.int64()), pa.array(text_keys, pa.int64()), pa.array(firsts, pa.int32()), pa.array(offs, pa.int32()), pa.array(ctx, pa.string())],
                        ["fp", "doc_id", "text_key", "first_word", "anchor", "ctx"],
                    )
                    fps, docs, text_keys, firsts, offs, ctx = [], [], [], [], [], []

    return run


def confirm(fp: list[int], anchor: list[int], ctx: list[str], low: list[int], high: list[int], mark: list[int], words: int = WORDS) -> list[str]:
    """Passages of contexts that at least two documents share, each as long as the same documents share it.

    low, high and mark describe the documents that hold a context: the least and greatest
    doc_id, and a sum of hashes.
    """
    half = words // 2
    seen: dict[tuple[int, str], list[int]] = {}
    places = []
    for i, text in enumerate(ctx):
        edge = [0]
        at = text.find(" ")
        while at >= 0:
            edge.append(at + 1)
            at = text.find(" ", at + 1)
        edge.append(len(text) + 1)
        n = len(edge) - 1
        starts = range(max(0, anchor[i] + half - words), min(anchor[i], n - words) + 1)
        places.append((edge, starts))
        for w in starts:
            k = (fp[i], text[edge[w] : edge[w + words] - 1])
            x = seen.get(k)
            if x is None:
                seen[k] = [low[i], high[i], mark[i]]
            else:
                x[0] = min(x[0], low[i])
                x[1] = max(x[1], high[i])
                x[2] = (x[2] + mark[i]) & ((1 << 64) - 1)
    out: set[str] = set()
    for i, text in enumerate(ctx):
        edge, starts = places[i]
        begin, who = None, None
        for w in starts:
            x = seen[fp[i], text[edge[w] : edge[w + words] - 1]]
            if begin is not None and (x[0] == x[1] or x != who):
                out.add(text[edge[begin] : edge[w - 1 + words] - 1])
                begin = None
            if x[0] != x[1] and begin is None:
                begin, who = w, x
        if begin is not None:
            out.add(text[edge[begin] : edge[starts[-1] + words] - 1])
    return sorted(out)


def compile_automaton(phrases: list[str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for p in phrases:
        a.add_word(f" {p} ", len(p) + 2)
    a.make_automaton()
    return a


def occurrences(automaton: ahocorasick.Automaton, text: str) -> list[tuple[int, int]]:
    """Spans of words (first, end) of a single-spaced text that phrases cover, joined where they overlap or touch."""
    padded = f" {text} "
    spans: list[list[int]] = []
    for end, size in automaton.iter(padded):
        a, b = end - size + 1, end  # from the space before to the space after
        while spans and spans[-1][0] >= a:
            spans.pop()
        if spans and spans[-1][1] >= a:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return [(padded.count(" ", 0, a), padded.count(" ", 0, b)) for a, b in spans]


def _shard(words: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        cols = {c: frame[c].tolist() for c in frame.columns}
        phrases = confirm(cols["fp"], cols["anchor"], cols["ctx"], cols["low"], cols["high"], cols["mark"], words)
        out = {"fp": [], "ctx_key": [], "anchor": [], "a": [], "b": []}
        if phrases:
            automaton = compile_automaton(phrases)
            for fp, key, anchor, text in zip(cols["fp"], cols["ctx_key"], cols["anchor"], cols["ctx"]):
                for a, b in occurrences(automaton, text):
                    out["fp"].append(fp)
                    out["ctx_key"].append(key)
                    out["anchor"].append(anchor)
                    out["a"].append(a)
                    out["b"].append(b)
        return pd.DataFrame(out)

    return run


def passages(docs: DataFrame, words: int = WORDS, hot: int = HOT) -> DataFrame:
    """(doc_id, start_word, end_word, n_words) of every maximal span that recurring passages of so many words or more cover."""
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").where("doc_id is not null and text is not null")
    found = written(d.mapInArrow(_anchors(words), "fp bigint, doc_id bigint, text_key bigint, pos int"), "anchors")
    shared = found.groupBy("fp").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x <> y").select("fp")
    mine = found.join(shared, "fp").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("fp", "pos")).alias("found"))
    cut = d.join(mine, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "found")
    cut = written(cut.mapInArrow(_contexts(words), "fp bigint, doc_id bigint, text_key bigint, first_word int, anchor int, ctx string").withColumn("ctx_key", F.xxhash64("ctx")), "contexts")
    # Equal contexts of one anchor are looked at once, however many documents hold them.
    one = cut.groupBy("fp", "ctx_key", "anchor", "ctx").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("mark"))
    one = written(one.withColumn("mark", F.expr("cast(pmod(mark, 9223372036854775783BD) as bigint)")), "contexts-one")
    many = small(written(one.groupBy("fp").count().where(F.col("count") > hot).select("fp"), "hot-anchors"), 16)
    shards = max(1, math.ceil(one.count() / SHARD_CONTEXTS))
    hit = one.join(many, "fp", "left_anti").withColumn("shard", F.pmod(F.xxhash64("fp"), F.lit(shards))).groupBy("shard").applyInPandas(_shard(words), "fp bigint, ctx_key bigint, anchor int, a int, b int")
    hit = written(hit.unionByName(hot_hits(one.join(many, "fp", "left_semi"), words)), "hits")
    span = cut.select("fp", "ctx_key", "anchor", "doc_id", "text_key", "first_word").join(hit, ["fp", "ctx_key", "anchor"])
    span = span.select("doc_id", "text_key", (F.col("first_word") + F.col("a")).alias("a"), (F.col("first_word") + F.col("b")).alias("b")).distinct()
    w = W.Window.partitionBy("doc_id", "text_key").orderBy("a", "b")
    upto = F.max("b").over(w.rowsBetween(W.Window.unboundedPreceding, -1))
    span = span.withColumn("new", F.when(upto.isNull() | (F.col("a") > upto), 1).otherwise(0)).withColumn("island", F.sum("new").over(w.rowsBetween(W.Window.unboundedPreceding, 0)))
    out = span.groupBy("doc_id", "text_key", "island").agg(F.min("a").alias("start_word"), F.max("b").alias("end_word"))
    return out.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words")).distinct()
