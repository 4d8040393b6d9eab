"""Operator 7: language-model scores by prediction by partial matching over bytes.

All documents are counted: every byte with the ORDER bytes before it is a gram, and the shorter
contexts' counts follow from the longest's.  The grams make a trie of byte contexts, pretrained
on the whole corpus; a symbol is coded in its longest known context, or the coder escapes to
the next shorter one (method C: the escape weighs as many as the context's distinct symbols),
leaving out the symbols that the longer context would have coded.  A document's score is its
code length.

All grams seen min_count times are kept, however many.  The trie goes to every executor in
shards of about SHARD_GRAMS grams, cut by the last KEY_BYTES bytes of the context, last byte
first: a gram's contexts of all lengths then lie in one shard, so each shard is a whole model
for its grams.  With more than one shard a task holds documents up to HELD_BYTES and has one
shard in memory at a time.

Defined results: an empty or null text has no bytes, no bits and null bits per byte; before
the first byte the context is zero bytes; every row is scored for itself, so repeated rows and
ids give repeated scores and a null doc_id is kept; an empty table gives no rows; extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .shared import written

ORDER = 4
MIN_COUNT = 2
SHARD_GRAMS = 2_000_000
KEY_BYTES = 3
HELD_BYTES = 128 << 20


def grams(buf: np.ndarray, off: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For each byte, it and the order bytes before it as one number; and each byte's row."""
    rows = np.repeat(np.arange(len(off) - 1), np.diff(off))
    wide = np.zeros(len(buf) + order * (len(off) - 1), np.uint8)
    at = np.arange(len(buf)) + order * (rows + 1)
    wide[at] = buf
    g = np.zeros(len(wide) - order if len(wide) > order else 0, np.int64)
    for k in range(order + 1):
        g <<= 8
        g |= wide[k : k + len(g)]
    return g[at - order], rows


@dataclass
class Level:
    """Contexts of one length: grams (context and symbol) with counts, and sums for each context."""

    grams: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    distinct: np.ndarray
    excluded: np.ndarray  # what the shorter context counts for the symbols known here


def _at(keys: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(q), np.int64), np.zeros(len(q), bool)
    i = np.minimum(np.searchsorted(keys, q), len(keys) - 1)
    return i, keys[i] == q


class Model:
    def __init__(self, counted: list[tuple[np.ndarray, np.ndarray]]):
        """From the grams of each length, shortest first, with their counts."""
        self.order = len(counted) - 1
        self.levels: list[Level] = []
        for k, (g, c) in enumerate(counted):
            by = np.argsort(g)
            g, c = g[by], c[by]
            ctx, where = np.unique(g >> 8, return_inverse=True)
            if k:
                i, known = _at(self.levels[-1].grams, g & ((1 << 8 * k) - 1))
                if not known.all():
                    raise ValueError(f"grams of {k + 1} bytes without their last {k}")
                excluded = np.bincount(where, self.levels[-1].counts[i] if len(g) else c, len(ctx))
            else:
                excluded = np.zeros(len(ctx))
            self.levels.append(Level(g, c, ctx, np.bincount(where, c, len(ctx)), np.bincount(where, minlength=len(ctx)).astype(float), excluded))
        top = self.levels[-1]
        i, _ = _at(top.contexts, top.grams >> 8)
        cost = np.log2((top.total[i] + top.distinct[i]) / top.counts) if len(top.grams) else np.zeros(0)
        self._hash(top.grams, cost)

    def _hash(self, keys: np.ndarray, cost: np.ndarray) -> None:
        bits = max(10, int(4 * len(keys)).bit_length())
        self.shift, mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key = np.full(1 << bits, -1, np.int64)
        self.slot_cost = np.zeros(1 << bits, np.float32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        self.probes = 0
        while len(left):
            free = self.slot_key[slot] == -1
            self.slot_key[slot[free]] = keys[left[free]]
            mine = self.slot_key[slot] == keys[left]
            self.slot_cost[slot[mine]] = cost[left[mine]]
            left, slot = left[~mine], (slot[~mine] + 1) & mask
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def bits(self, g: np.ndarray) -> np.ndarray:
        """Code length of each gram's last byte after the bytes before it."""
        slot = self._slot(g)
        found = self.slot_key[slot]
        out = self.slot_cost[slot].astype(np.float64)
        miss = np.flatnonzero(found != g)
        at = slot[miss]
        for _ in range(self.probes - 1):
            open_ = self.slot_key[at] != -1
            nxt = (at + 1) & (len(self.slot_key) - 1)
            hit = open_ & (self.slot_key[nxt] == g[miss])
            out[miss[hit]] = self.slot_cost[nxt[hit]]
            go = open_ & ~hit
            keep_missing = ~hit & ~go
            if keep_missing.any():
                self._escape(g, miss[keep_missing], out)
            miss, at = miss[go], nxt[go]
            if not len(miss):
                break
        if len(miss):
            self._escape(g, miss, out)
        return out

    def _escape(self, g: np.ndarray, todo: np.ndarray, out: np.ndarray) -> None:
        out[todo] = 0
        gone_total = np.zeros(len(todo))
        gone_distinct = np.zeros(len(todo))
        for k in range(self.order, -1, -1):
            level = self.levels[k]
            q = g[todo] & ((1 << 8 * (k + 1)) - 1)
            i, known = _at(level.contexts, q >> 8)
            j, hit = _at(level.grams, q)
            total = np.where(known, level.total[i] if len(level.total) else 0, 0) - gone_total
            distinct = np.where(known, level.distinct[i] if len(level.distinct) else 0, 0) - gone_distinct
            if hit.any():
                out[todo[hit]] += np.log2((total[hit] + distinct[hit]) / level.counts[j[hit]])
            esc = known & ~hit & (distinct > 0)
            out[todo[esc]] += np.log2((total[esc] + distinct[esc]) / distinct[esc])
            gone_total = np.where(known, level.excluded[i] if len(level.excluded) else 0, 0)[~hit]
            gone_distinct = np.where(known, level.distinct[i] if len(level.distinct) else 0, 0)[~hit]
            todo = todo[~hit]
        root = self.levels[0]
        out[todo] += np.log2(256 - (root.distinct[0] if len(root.distinct) else 0))


def _count(order: int):
    def merge(parts):
        g, c = (np.concatenate(x) for x in zip(*parts))
        u, back = np.unique(g, return_inverse=True)
        return u, np.bincount(back, c, len(u)).astype(np.int64)

    def run(batches):
        parts, size = [], 0
        for b in batches:
            for _, _, buf, off in tn.slices(tn.column(b, "text")):
                g = np.sort(grams(buf, off, order)[0])
                if not len(g):
                    continue
                edge = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
                parts.append((g[edge], np.diff(np.r_[edge, len(g)])))
                size += len(edge)
                if size > 1 << 20:
                    parts = [merge(parts)]
                    size = 0
        if parts:
            g, c = merge(parts)
            for lo in range(0, len(g), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(g[lo : lo + (1 << 16)]), pa.array(c[lo : lo + (1 << 16)])], ["gram", "n"])

    return run


def _place(ctx):
    """Where a context (an array or a column) lies: its last KEY_BYTES bytes, last byte first."""
    if isinstance(ctx, Column):
        byte = lambda i: F.shiftleft(F.shiftright(ctx, 8 * i).bitwiseAND(255), 8 * (KEY_BYTES - 1 - i))
    else:
        byte = lambda i: (ctx >> 8 * i & 255) << 8 * (KEY_BYTES - 1 - i)
    return sum((byte(i) for i in range(1, KEY_BYTES)), byte(0))


def trie(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT) -> DataFrame:
    """(k, gram, n, place) of every gram of k + 1 bytes, k up to the order, seen min_count times in all documents."""
    g = docs.select("text").where("text is not null").mapInArrow(_count(order), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    g = written(g, "grams")
    shorter = lambda x, k: x.groupBy(F.col("gram").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("gram")).agg(F.sum("n").alias("n"))
    by = {order: g}
    if order:
        by[order - 1] = written(shorter(g, order - 1), "grams-lower")
    for k in range(order - 1):
        by[k] = shorter(by[order - 1], k)
    levels = [x.where(F.col("n") >= min_count).select(F.lit(k).alias("k"), "gram", "n", _place(F.shiftright("gram", 8)).alias("place")) for k, x in by.items()]
    return written(reduce(DataFrame.unionByName, levels), "trie")


def _load(t: DataFrame, order: int) -> Model:
    x = t.select("k", "gram", "n").toPandas()
    k, g, n = (x[c].to_numpy(np.int64) for c in ("k", "gram", "n"))
    return Model([(g[k == i], n[k == i]) for i in range(order + 1)])


def cuts(t: DataFrame, limit: int) -> np.ndarray:
    """First places of the shards, each of about limit grams: a context of KEY_BYTES bytes is not cut."""
    bits = 8  # contexts are counted by all but their first byte, and by all of it only where that is too coarse
    t = t.where(F.col("k") >= KEY_BYTES - 1)
    coarse = t.groupBy(F.shiftright("place", bits).alias("at")).count().collect()
    big = {r["at"] for r in coarse if r["count"] > limit}
    sizes = [(r["at"] << bits, r["count"]) for r in coarse if r["at"] not in big]
    if big:
        fine = t.where(F.shiftright("place", bits).isin(sorted(big))).groupBy("place").count()
        sizes += [(r["place"], r["count"]) for r in fine.collect()]
    first, held = [0], 0
    for place, n in sorted(sizes):
        if held and held + n > limit:
            first.append(place)
            held = 0
        held += n
    return np.array(first, np.int64)


def shards(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, limit: int = SHARD_GRAMS) -> tuple[np.ndarray, Iterator[Model]]:
    """The first places of the shards of the model of all documents, and the shards one by one."""
    t = trie(docs, order, min_count)
    first = cuts(t, limit)
    if len(first) == 1:
        return first, iter([_load(t, order)])
    t = written(t.repartitionByRange("place").sortWithinPartitions("place"), "trie-sorted")
    ends = [*first[1:].tolist(), 1 << 8 * KEY_BYTES]
    # A context shorter than the key lies in every shard that has a longer one ending with it.
    width = F.expr(f"shiftleft(1L, 8 * greatest({KEY_BYTES} - k, 0))")
    return first, (_load(t.where((F.col("place") < hi) & (F.col("place") + width > lo)), order) for lo, hi in zip(first.tolist(), ends))


def fit(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, max_grams: int | None = None) -> Model:
    """The model in one piece, for a caller with the memory for it; max_grams makes a lesser model of the longest grams seen most."""
    t = trie(docs, order, min_count)
    if max_grams is not None:
        top = t.where(F.col("k") == order)
        t = t.where(F.col("k") < order).unionByName(top.where(F.col("n") >= _floor(top, min_count, max_grams)))
    return _load(t, order)


def _floor(g: DataFrame, floor: int, limit: int) -> int:
    """The least count, from floor on, that no more than limit grams reach (or those seen most)."""
    size = 0
    for r in g.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        if size and size + r["count"] > limit:
            return r["n"] + 1
        size += r["count"]
    return floor


def from_counts(grams: np.ndarray, counts: np.ndarray, order: int = ORDER, min_count: int = MIN_COUNT) -> Model:
    """The model of all grams' counts at hand."""
    levels = []
    for k in range(order + 1):
        g, back = np.unique(grams & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
        c = np.bincount(back, counts, len(g)).astype(np.int64)
        levels.append((g[c >= min_count], c[c >= min_count]))
    return Model(levels)


OUT = "doc_id bigint, n_bytes bigint, bits double, bits_per_byte double"


def _piecewise(first: np.ndarray, sent: list, order: int):
    """Scores with one shard in memory at a time, over as many documents as HELD_BYTES take."""

    def flush(held):
        for s, shard in enumerate(sent):
            model = None
            for _, _, g, _, bits in held:
                mine = np.flatnonzero(np.searchsorted(first, _place(g >> 8), "right") - 1 == s)
                if len(mine):
                    model = model or shard.value
                    bits[mine] = model.bits(g[mine])
            shard.__dict__.pop("_value", None)  # else every shard would stay in memory
        for ids, off, _, back, bits in held:
            row = np.repeat(np.arange(len(off) - 1), np.diff(off))
            yield _scored(ids, off, np.bincount(row, bits[back], len(off) - 1))

    def run(batches):
        held, size = [], 0
        for b in batches:
            for lo, hi, buf, off in tn.slices(tn.column(b, "text")):
                g, back = np.unique(grams(buf, off, order)[0], return_inverse=True)
                held.append((b.column(0).slice(lo, hi - lo), off, g, back.astype(np.int32), np.zeros(len(g))))
                size += sum(x.nbytes for x in held[-1][1:])
                if size > HELD_BYTES:
                    yield from flush(held)
                    held, size = [], 0
        yield from flush(held)

    return run


def _scored(ids: pa.Array, off: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
    size = np.diff(off)
    rate = pa.array(bits / np.maximum(size, 1), mask=size == 0)
    return pa.RecordBatch.from_arrays([ids, pa.array(size), pa.array(bits), rate], ["doc_id", "n_bytes", "bits", "bits_per_byte"])


def score(docs: DataFrame, model: Model | None = None, order: int = ORDER, shard_grams: int = SHARD_GRAMS) -> DataFrame:
    """(doc_id, n_bytes, bits, bits_per_byte) of every row, under a model of all rows if none is given."""
    first, models = (np.zeros(1, np.int64), iter([model])) if model else shards(docs, order, limit=shard_grams)
    sent = []
    for m in models:
        sent.append(docs.sparkSession.sparkContext.broadcast(m))
        if len(first) > 1:
            sent[-1].__dict__.pop("_value", None)  # it is in a file; the driver too holds one shard at a time

    def whole(batches):
        model = sent[0].value
        for b in batches:
            for lo, hi, buf, off in tn.slices(tn.column(b, "text")):
                g, row = grams(buf, off, model.order)
                yield _scored(b.column(0).slice(lo, hi - lo), off, np.bincount(row, model.bits(g), hi - lo))

    run = whole if len(first) == 1 else _piecewise(first, sent, order)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, OUT)
