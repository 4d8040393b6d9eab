"""Operator 6: near duplicates by SimHash, with pivot distance tables.

Each document gets a 128-bit SimHash of its distinct lower-case words.  Equal fingerprints
collapse to one.  Blocks of comparable fingerprints come from a cover: sets of bits such that
any two fingerprints within the radius agree on all bits of at least one set, so every such
pair meets in a block; how many sets of how many bits depends on the number of fingerprints,
which changes the cost and not the result.  In a block, the Hamming
distances of every fingerprint to many reference fingerprints form the pivot table: by the
triangle inequality a pair whose coordinates differ anywhere by more than the radius cannot be
within it, so it is discarded without loss; survivors are verified by their own distance.
Linked documents form groups by connected components.  In a block of more than LARGE fingerprints
one pivot, the one that tells them apart best, bounds the run of others that each is compared with.
Where such a block has more than DENSE pairs a fingerprint, its components are found by search
from fingerprint to fingerprint, each compared only with those not yet reached, which gives the
same groups.

Defined results: a null or wordless text is compared with nothing; a null doc_id has no
identity and is left out of groups; rows repeated under one doc_id are one document, near to
all that is near to any of its texts; an empty table gives no rows; texts of any length are
hashed whole; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .shared import components, small, written

BITS = 128
RADIUS = 20
PIVOTS = 128
FEW = 16  # pivots of a large block
RECALL = 0.9
MAX_BITS = 40
# Weights of a cover, in microseconds or so, and how often a bit of two unrelated documents agrees, fitted.  They decide
# between covers, not on results.  A pair took 0.004; at 0.006 small tables take more sets, and the shuffle grows more evenly.
ROW_COST, PAIR_COST, AGREE = 3.0, 0.006, 0.53
LARGE = 24
DENSE = 16


def fingerprint_slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, words per row, fingerprints as two 64-bit columns), slice by slice."""
    for lo, hi, buf, off in tn.slices(texts):
        s, e, d = tn.tokens(buf, off)
        key = np.sort((d.astype(np.uint64) << np.uint64(44)) | (tn.span_hash(buf, s, e) >> np.uint64(20)))
        if len(key):
            key = key[np.r_[True, key[1:] != key[:-1]]]
        row = (key >> np.uint64(44)).astype(np.int64)
        count = np.bincount(row, minlength=hi - lo)
        out = np.zeros((hi - lo, BITS // 64), np.int64)
        if len(key):
            at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            word = key & np.uint64((1 << 44) - 1)
            for z in range(BITS // 64):
                bits = np.unpackbits(tn.mix(word, z + 1).view(np.uint8).reshape(-1, 8), axis=1)
                ones = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
                up = ones * 2 > count[row[at]][:, None]
                out[row[at], z] = np.packbits(up, axis=1).view(np.int64).ravel()
        yield lo, hi, count, out


def _fingerprints(batches):
    for b in batches:
        ids = b.column(0)
        for lo, hi, count, fp in fingerprint_slices(tn.column(b, "text", lower=True)):
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), pa.array(count.astype(np.int32)), pa.array(fp[:, 0]), pa.array(fp[:, 1])],
                ["doc_id", "n_words", "f0", "f1"],
            )


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, f0, f1) for every row with a doc_id."""
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null")
    return d.mapInArrow(_fingerprints, "doc_id bigint, n_words int, f0 bigint, f1 bigint")


def plan_tables(n: int, radius: int = RADIUS, recall: float = RECALL) -> tuple[int, int]:
    """(bits a sample, samples): a pair at the radius itself shares a sample with the given probability."""
    k = min(MAX_BITS, max(8, math.ceil(math.log2(max(n, 2)))))
    p = math.comb(BITS - radius, k) / math.comb(BITS, k)  # a sample draws without replacement
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def cover(parts: int, radius: int = RADIUS) -> list[np.ndarray]:
    """Sets of bits such that fingerprints within the radius agree on all bits of at least one.

    The bits fall into parts, and radius + 1 is dealt out over them, so that in some part fewer
    bits differ than it was dealt, q.  Its bits have non-zero vectors of q binary digits (CoveringLSH,
    Pagh 2016); fewer than q vectors are all orthogonal to some non-zero v, and the set of v is the
    bits whose vectors are not.
    """
    sets, at = [], 0
    for p in range(parts):
        width = BITS // parts + (p < BITS % parts)
        q = (radius + 1) // parts + (p < (radius + 1) % parts)
        vector = (1 << q) - 1 - np.arange(width) % ((1 << q) - 1)
        sets += [at + np.flatnonzero(np.bitwise_count(vector & v) & 1) for v in range(1, 1 << q)]
        at += width
    return sets


def plan_cover(n: int, radius: int = RADIUS) -> list[np.ndarray]:
    """The cover that costs n fingerprints least: ROW_COST for each in a block, PAIR_COST for each two in one."""

    def cost(sets: list[np.ndarray]) -> float:
        return ROW_COST * len(sets) + PAIR_COST * n / 2 * sum(AGREE ** min(len(s), MAX_BITS) for s in sets)

    most = min(radius + 1, BITS)
    least = min(most, math.ceil((radius + 1) / 6))
    return min((cover(m, radius) for m in range(least, most + 1)), key=cost)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=-1, dtype=np.int32)


def pivot_table(fp: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Hamming distance of each fingerprint to each reference fingerprint, one byte each."""
    ref = tn.mix(np.arange(1, pivots * 2 + 1, dtype=np.uint64), 77).view(np.int64).reshape(pivots, 2)
    out = np.empty((len(fp), pivots), np.uint8)
    for p in range(pivots):
        out[:, p] = hamming(fp, ref[p])
    return out


def block_pairs(group: np.ndarray, fp: np.ndarray, radius: int, pivots: int = PIVOTS) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (i, j) of rows of one group (sorted) within the radius, and how many pairs the pivots discarded."""
    near = pivot_table(fp, pivots).astype(np.int16)
    left, right, dropped = [], [], 0
    i = np.arange(len(group))
    step = 1
    while True:
        i = i[: np.searchsorted(i, len(group) - step)]
        i = i[group[i] == group[i + step]]
        if not len(i):
            break
        for c in range(0, len(i), 1 << 15):
            a = i[c : c + (1 << 15)]
            b = a + step
            n = len(a)
            for q in range(0, pivots, 32):  # a pair that fails early is not looked at again
                ok = np.abs(near[a, q : q + 32] - near[b, q : q + 32]).max(axis=1) <= radius
                a, b = a[ok], b[ok]
            dropped += n - len(a)
            ok = hamming(fp[a], fp[b]) <= radius
            left.append(a[ok])
            right.append(b[ok])
        step += 1
    z = np.zeros(0, np.int64)
    return np.concatenate(left or [z]), np.concatenate(right or [z]), dropped


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) with node > root: the same components as the edges have, with fewer edges."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        old = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        if (old == root).all():
            break
    k = root != np.arange(len(ids))
    return ids[k], ids[root[k]]


def reached(fp: np.ndarray, radius: int, pivots: int = PIVOTS) -> tuple[np.ndarray, np.ndarray]:
    """(row, root row) of every row linked to another: the components of one block, without all its pairs.

    Rows stand by their distance to the pivot that tells them apart best, so those that it does
    not discard are one run.
    """
    near = pivot_table(fp, pivots)
    near = near[:, near.std(axis=0).argmax()]
    order = np.argsort(near, kind="stable")
    at, a, b = near[order].astype(np.int16), fp[order, 0].view(np.uint64), fp[order, 1].view(np.uint64)
    left = np.arange(len(fp))  # places not yet reached, in order
    la, lb, ln = a, b, at
    rows, roots = [], []
    while len(left):
        root = left[0]
        queue, skip = [root], 1
        while queue:
            v = queue.pop()
            lo, hi = max(skip, int(np.searchsorted(ln, at[v] - radius))), int(np.searchsorted(ln, at[v] + radius, "right"))
            if hi > lo:
                u = lo + np.flatnonzero(np.bitwise_count(la[lo:hi] ^ a[v]) + np.bitwise_count(lb[lo:hi] ^ b[v]) <= radius)
                if len(u):
                    rows.append(left[u])
                    roots.append(np.full(len(u), root))
                    queue += left[u].tolist()
                    left, la, lb, ln = (np.delete(x, u) for x in (left, la, lb, ln))
            if len(left) == skip:
                break
        left, la, lb, ln = left[1:], la[1:], lb[1:], ln[1:]
    z = np.zeros(0, np.int64)
    return order[np.concatenate(rows or [z])], order[np.concatenate(roots or [z])]


def linked(fp: np.ndarray, near: np.ndarray, radius: int, dense: int = DENSE, cells: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one block, near its pivot table, with the same components as all its pairs within the radius."""
    near = near[:, near.std(axis=0).argmax()].astype(np.int16)
    order = np.argsort(near, kind="stable")
    near, a, b = near[order], fp[order, 0].view(np.uint64), fp[order, 1].view(np.uint64)
    left, right, found, lo = [], [], 0, 0
    while lo < len(a) - 1:
        hi = min(len(a), lo + max(1, cells // (len(a) - lo)))
        end = int(np.searchsorted(near, near[hi - 1] + radius, "right"))  # the pivot discards the rest
        i, j = np.divmod(np.flatnonzero(np.bitwise_count(a[lo:hi, None] ^ a[lo:end]) <= radius), end - lo)
        k = j > i
        i, j = i[k] + lo, j[k] + lo
        k = np.bitwise_count(a[i] ^ a[j]) + np.bitwise_count(b[i] ^ b[j]) <= radius
        left.append(order[i[k]])
        right.append(order[j[k]])
        found += len(left[-1])
        if found > dense * len(a):
            return reached(fp, radius, FEW)
        lo = hi
    z = np.zeros(0, np.int64)
    return np.concatenate(left or [z]), np.concatenate(right or [z])


def _keys(sets: list[np.ndarray]):
    sets = [s[:MAX_BITS] for s in sets]
    place = 1 << np.arange(MAX_BITS, dtype=np.int64)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1 << 13):
                c = b.slice(lo, 1 << 13)
                fp = np.stack([c.column(1).to_numpy(zero_copy_only=False), c.column(2).to_numpy(zero_copy_only=False)], axis=1)
                bits = np.unpackbits(fp.view(np.uint8), axis=1)
                key = np.concatenate([bits[:, s] @ place[: len(s)] + (t << 44) for t, s in enumerate(sets)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(np.tile(c.column(0).to_numpy(zero_copy_only=False), len(sets))), pa.array(np.tile(fp[:, 0], len(sets))), pa.array(np.tile(fp[:, 1], len(sets)))],
                    ["key", "doc_id", "f0", "f1"],
                )

    return run


def _compare(radius: int, large: int = LARGE):
    def pairs(key, ids, fp):
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[edge, len(key)])
        block = np.repeat(size, size)
        some = (block > 1) & (block <= large)
        i, j, _ = block_pairs(key[some], fp[some], radius)
        a, b = [ids[some][i]], [ids[some][j]]
        near = pivot_table(fp, FEW) if (size > large).any() else None
        for lo, n in zip(edge[size > large], size[size > large]):
            i, j = linked(fp[lo : lo + n], near[lo : lo + n], radius)
            a.append(ids[lo + i])
            b.append(ids[lo + j])
        a, b = np.concatenate(a), np.concatenate(b)
        if not len(a):
            return None
        node, root = local_roots(a, b)
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["a", "b"])

    def run(batches):
        held: list[np.ndarray] = []  # rows of one key, the last so far
        for b in batches:
            if not b.num_rows:
                continue
            held.append(np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in range(4)]))
            if held[0][0, 0] == held[-1][0, -1]:
                continue
            x = np.concatenate(held, axis=1)
            cut = int(np.searchsorted(x[0], x[0, -1]))
            held = [x[:, cut:]]
            if (out := pairs(x[0, :cut], x[1, :cut], x[2:, :cut].T.copy())) is not None:
                yield out
        if held:
            x = np.concatenate(held, axis=1)
            if (out := pairs(x[0], x[1], x[2:].T.copy())) is not None:
                yield out

    return run


def groups(docs: DataFrame, radius: int = RADIUS, recall: float = 1.0) -> DataFrame:
    """(doc_id, group_id, group_size): every document that has a near duplicate; group_id is the least doc_id of its group.

    A recall under 1 takes samples of bits in place of the cover: a pair at the radius is then found with that probability.
    """
    fps = written(fingerprints(docs), "simhash").where("n_words > 0")
    one = written(fps.groupBy("f0", "f1").agg(F.min("doc_id").alias("doc_id")), "simhash-one")
    n = one.count()
    if recall < 1:
        k, tables = plan_tables(n, radius, recall)
        sets = [np.random.default_rng(1000 + t).choice(BITS, k, replace=False) for t in range(tables)]
    else:
        sets = plan_cover(n, radius)
    near = (
        one.select("doc_id", "f0", "f1")
        .mapInArrow(_keys(sets), "key bigint, doc_id bigint, f0 bigint, f1 bigint")
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(_compare(radius), "a bigint, b bigint")
    )
    member = written(fps.join(one.withColumnRenamed("doc_id", "first"), ["f0", "f1"]).select("doc_id", "first").distinct(), "simhash-member")
    several = member.groupBy("doc_id").agg(F.min("first").alias("b"), F.max("first").alias("a")).where("a <> b").select("doc_id", "b")
    texts = member.join(several, "doc_id").select(F.col("first").alias("a"), "b")  # of one document
    root = components(near.unionByName(texts)).withColumnRenamed("node", "first")
    home = member.join(root, "first", "left").select("doc_id", F.coalesce("root", "first").alias("group_id")).distinct()
    sizes = home.groupBy("group_id").agg(F.count("*").alias("group_size")).where("group_size > 1")
    return home.join(sizes, "group_id").select("doc_id", "group_id", "group_size")


def dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs without those near duplicates whose doc_id is not the least of their group."""
    drop = groups(docs, radius).where("doc_id <> group_id").select(F.col("doc_id").alias("_drop_id")).distinct()
    drop = small(written(drop, "copies"), 32)
    return docs.join(drop, docs["doc_id"] == drop["_drop_id"], "left_anti")
