"""Operator 3: benchmark decontamination by a BM25 inverted index with block-max WAND.

The test items are indexed, not the corpus: every passage of every document is a query against
the items.  An item's passages are windows that hold it wherever it stands, a stride apart, of
the first length in a fixed row of lengths that is enough (window_cells); items of one length
are indexed together, so that what is found of an item depends on no other item's length.
Weights are BM25's, divided by the item's score against itself, so that one threshold serves all.
Passages that cannot reach it are discarded by the items' essential terms (those without which
the rest of an item's weight stays under the threshold), which loses nothing; the others go
through block-max WAND, which returns every item at or above the threshold.  A hit counts when
both the question's and the answer's word triples occur in the passage.

The index is sent to the executors in shards of at most shard_bytes of item text, as many in
one pass over the documents as PASS_BYTES take; document frequencies are those of all items
whatever the shards.

Defined results: a null or wordless text has no passages and a null or wordless item no terms,
so neither is ever reported; rows repeated under one doc_id or item_id give one row, that of the
best passage (score, then overlaps); a null doc_id or item_id is not reported; ties need no
order, as all hits are returned; texts of any length are read whole; empty tables give no rows;
extra columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .shared import small, written

K1, B = 1.2, 0.75
THRESHOLD = 0.6
STRIDE = 32
OVERLAP = 0.6
GRAM = 3
BLOCK = 32
#: The share of the threshold that an item's commonest terms, left out of the first bound, may weigh.
COMMON = 0.5
SHARD_BYTES = 8 << 20
PASS_BYTES = 64 << 20
_MARKS = ("\nanswer:", " answer:", "\na:")


def answer_at(text: str) -> int:
    """Where the answer begins: after an answer mark, else after the last question mark, else at two thirds of the words."""
    for m in _MARKS:
        if (at := text.rfind(m)) > 0:
            return at + len(m)
    if 0 < (at := text.rfind("?")) < len(text.rstrip()) - 1:
        return at + 1
    buf = np.frombuffer(text.encode(), np.uint8)
    s, _, _ = tn.tokens(buf, np.array([0, len(buf)]))
    return len(bytes(buf[: s[len(s) * 2 // 3]]).decode()) if len(s) else 0


def hashes(text: str) -> np.ndarray:
    buf = np.frombuffer(text.encode(), np.uint8)
    s, e, _ = tn.tokens(buf, np.array([0, len(buf)]))
    return tn.span_hash(buf, s, e)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of runs of n words; a shorter text is one run."""
    if len(h) == 0:
        return h
    n = min(n, len(h))
    at = np.arange(len(h) - n + 1)
    return tn.span_hash(h, at, at + n)


def window_cells(words: int) -> int:
    """Strides in a window for an item of so many words: enough to hold it anywhere, rounded up to 2, 3, 4, 6, 8, 12, 16, ..."""
    need = math.ceil(words / STRIDE) + 1
    top = 2
    while top < need:
        top = top * 3 // 2 if top & (top - 1) == 0 else top * 4 // 3
    return top


class Index:
    """Postings of items of one window length, with a maximum for each block and each list."""

    def __init__(self, items: list[tuple[int, str]], df: dict[int, int], n_items: int, avg_len: float, threshold: float = THRESHOLD, cells: int = 2):
        self.ids = [i for i, _ in items]
        self.cells = cells
        self.threshold = threshold
        self.question, self.answer = [], []
        post: dict[int, list[tuple[int, float]]] = {}
        essential: dict[int, list[tuple[int, float]]] = {}
        self.rest = np.zeros(len(items))
        for k, (_, text) in enumerate(items):
            h = hashes(text)
            at = answer_at(text)
            self.question.append(np.unique(grams(hashes(text[:at]), GRAM)))
            self.answer.append(np.unique(grams(hashes(text[at:]), GRAM)))
            term, tf = np.unique(h, return_counts=True)
            if not len(term):
                continue
            d = np.array([df[int(t)] for t in term])
            w = np.log(1 + (n_items - d + 0.5) / (d + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(h) / avg_len))
            w /= w.sum()
            for t, x in zip(term.tolist(), w.tolist()):
                post.setdefault(t, []).append((k, x))
            order = np.lexsort((w, -d))  # the commonest terms first
            low = np.cumsum(w[order]) < threshold * COMMON
            self.rest[k] = w[order][low].sum()
            for t, x in zip(term[order][~low].tolist(), w[order][~low].tolist()):
                essential.setdefault(t, []).append((k, x))
        self.terms = np.array(sorted(post), np.uint64)
        self.lists = []
        for t in self.terms.tolist():
            docs, ws = [k for k, _ in post[t]], [x for _, x in post[t]]
            last = [docs[min(i + BLOCK, len(docs)) - 1] for i in range(0, len(docs), BLOCK)]
            self.lists.append((docs, ws, max(ws), last, [max(ws[i : i + BLOCK]) for i in range(0, len(ws), BLOCK)]))
        e = [essential.get(t, []) for t in self.terms.tolist()]
        self.e_count = np.array([len(x) for x in e], np.int64)
        self.e_start = np.cumsum(self.e_count) - self.e_count
        self.e_item = np.array([k for x in e for k, _ in x], np.int64)
        self.e_weight = np.array([w for x in e for _, w in x])
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.terms & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of words that are terms, and their term numbers."""
        at = np.flatnonzero(self.sieve[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(self.terms):
            return at[:0], at[:0]
        t = np.minimum(np.searchsorted(self.terms, h[at]), len(self.terms) - 1)
        ok = self.terms[t] == h[at]
        return at[ok], t[ok]

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """(item, score) for every item at or above the threshold, by block-max WAND."""
        theta, out = self.threshold - 1e-9, []
        cur = [[self.lists[t][0][0], 0, self.lists[t]] for t in terms]  # current item, position, list

        def seek(c: list, item: int) -> None:
            c[1] = bisect_left(c[2][0], item, c[1])
            c[0] = c[2][0][c[1]] if c[1] < len(c[2][0]) else -1

        while True:
            cur = [c for c in cur if c[0] >= 0]
            cur.sort(key=lambda c: c[0])
            bound, p = 0.0, -1
            for i, c in enumerate(cur):
                bound += c[2][2]
                if bound >= theta:
                    p = i
                    break
            if p < 0:
                return out
            item = cur[p][0]
            while p + 1 < len(cur) and cur[p + 1][0] == item:
                p += 1
            block, edge = 0.0, cur[p + 1][0] if p + 1 < len(cur) else 1 << 60
            for c in cur[: p + 1]:
                b = bisect_left(c[2][3], item)
                if b < len(c[2][3]):
                    block += c[2][4][b]
                    edge = min(edge, c[2][3][b] + 1)
            if block < theta:  # no item before the nearest block's edge can reach it
                for c in cur[: p + 1]:
                    if c[0] < edge:
                        seek(c, edge)
            elif cur[0][0] == item:
                score = 0.0
                for c in cur[: p + 1]:
                    score += c[2][1][c[1]]
                    seek(c, item + 1)
                if score >= theta:
                    out.append((item, score))
            else:
                for c in cur[: p + 1]:
                    if c[0] < item:
                        seek(c, item)

    def passages(self, h: np.ndarray, row: np.ndarray, start: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, first word, end word) of the windows that some item's essential terms let through."""
        at, t = self.find(h)
        many = self.e_count[t]
        if not many.sum():
            return []
        who = np.repeat(np.arange(len(at)), many)
        slot = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many) + self.e_start[t[who]]
        item, weight, word = self.e_item[slot], self.e_weight[slot], at[who]
        cell = (word - start[row[word]]) // STRIDE
        n, width = len(self.ids), int(cell.max()) + 1
        full, back = np.unique((row[word] * n + item) * width + cell, return_inverse=True)
        upto = np.concatenate([[0.0], np.cumsum(np.bincount(back, weight))])
        pair, cell = full // width, full % width
        need = self.threshold - self.rest[pair % n] - 1e-7

        def mass(entry: np.ndarray, first: np.ndarray) -> np.ndarray:
            """What the window from cell first holds, entry being the first of its own that it holds."""
            end = np.minimum(pair[entry] * width + first + self.cells, (pair[entry] + 1) * width)
            return upto[np.searchsorted(full, end)] - upto[entry]

        # The best window over a cell begins at it; only if that one passes may those that begin up to the cell before.
        every = np.arange(len(full))
        hot = every[mass(every, cell) >= need]
        before = np.where(np.r_[False, pair[1:] == pair[:-1]], np.r_[0, cell[:-1]] + 1, 0)
        low = np.maximum(before, cell - self.cells + 1)[hot]
        count = cell[hot] - low + 1
        entry = np.repeat(hot, count)
        first = np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        ok = mass(entry, first) >= need[entry]
        got = np.unique(pair[entry[ok]] // n * width + first[ok])
        begin = start[got // width] + got % width * STRIDE
        return list(zip((got // width).tolist(), begin.tolist(), (begin + self.cells * STRIDE).tolist()))


def leaks_in(indices: list[Index], texts: pa.Array, overlap: float = OVERLAP):
    """Per slice: (row, item_id, score, question overlap, answer overlap), the best of each row and item of each index."""
    for lo, _, buf, off in tn.slices(texts):
        s, e, d = tn.tokens(buf, off)
        if not len(s):
            continue
        h = tn.span_hash(buf, s, e)
        start = np.searchsorted(d, np.arange(len(off)))
        for index in indices:
            best: dict[tuple[int, int], tuple] = {}
            for r, a, b in index.passages(h, d, start):
                b = min(b, int(start[r + 1]))
                _, t = index.find(h[a:b])
                for item, score in index.search(np.unique(t).tolist()):
                    g = grams(h[a:b], GRAM)
                    parts = []
                    for part in (index.question[item], index.answer[item]):
                        parts.append(float(np.isin(part, g).mean()) if len(part) else 1.0)
                        if len(part) == 1 and parts[-1] == 0:  # an answer of fewer words than a run
                            parts[-1] = float(np.isin(part, grams(h[a:b], 2)).mean() or np.isin(part, grams(h[a:b], 1)).mean())
                    if min(parts) >= overlap:
                        best[r, item] = max(best.get((r, item), (0.0, 0.0, 0.0)), (score, *parts))
            for (r, item), x in best.items():
                yield lo + r, index.ids[item], *x


OUT = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double"


def _terms(batches):
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        for lo, _, buf, off in tn.slices(tn.column(b, "text", lower=True)):
            s, e, d = tn.tokens(buf, off)
            yield pa.RecordBatch.from_arrays([pa.array(ids[lo + d]), pa.array(tn.span_hash(buf, s, e).view(np.int64))], ["item", "term"])


def build(benchmark: DataFrame, threshold: float = THRESHOLD, shard_bytes: int = SHARD_BYTES) -> Iterator[list[Index]]:
    """The items' index, in shards of about shard_bytes of text, each a list of indices by window length; one shard in memory at a time."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.lower("text").alias("text")).where("item_id is not null and text is not null").distinct()
    items = written(items.withColumn("row", F.monotonically_increasing_id()), "items")
    term = items.select("row", "text").mapInArrow(_terms, "item bigint, term bigint")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    words = term.count()
    df = written(term.distinct().groupBy("term").count(), "item-terms")
    shards = max(1, math.ceil(size / shard_bytes))
    for k in range(shards):
        mine = items.where(F.pmod(F.xxhash64("row"), F.lit(shards)) == k)
        have = mine.select("row", "text").mapInArrow(_terms, "item bigint, term bigint").select("term").distinct()
        counts = {r["term"] & ((1 << 64) - 1): r["count"] for r in df.join(have, "term", "left_semi").collect()}
        by: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for r in mine.select("item_id", "text").collect():
            by[window_cells(len(hashes(r["text"])))].append((r["item_id"], r["text"]))
        yield [Index(sorted(rows), counts, n, max(words / max(n, 1), 1e-9), threshold, cells) for cells, rows in sorted(by.items())]


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): every document that holds a test item."""
    parts = None
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null")
    sent = []
    for shard in build(benchmark, threshold, shard_bytes):
        sent.append(docs.sparkSession.sparkContext.broadcast(shard))
        sent[-1].__dict__.pop("_value", None)  # it is in a file; the driver need not hold it too
    each = max(1, PASS_BYTES // shard_bytes)
    for k in range(0, len(sent), each):

        def run(batches, sent=sent[k : k + each]):
            indices = [index for shard in sent for index in shard.value]
            for b in batches:
                ids = b.column(0).to_numpy(zero_copy_only=False)
                rows = list(leaks_in(indices, tn.column(b, "text", lower=True), overlap))
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[list(cols[0])]), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[2:])],
                        ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                    )

        x = d.mapInArrow(run, OUT)
        parts = x if parts is None else parts.unionByName(x)
    best = F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("best")
    return parts.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that hold a test item."""
    bad = small(written(leaks(docs, benchmark, threshold).select(F.col("doc_id").alias("_leak_id")).distinct(), "leaks"), 32)
    return docs.join(bad, docs["doc_id"] == bad["_leak_id"], "left_anti")
