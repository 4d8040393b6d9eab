"""Operator 4: embedding near-dedup in the cells of a spherical k-means.

Equal vectors collapse to one.  Spherical k-means over all vectors gives about as many cells as
the root of their number.  A vector joins its nearest cell and each other cell whose border is
nearer to it than half the way that a near duplicate may lie towards that border.  Of the two
ends of a pair across a border one is no farther from it than half the pair's extent in the
border's direction.  The difference of a pair at the wanted cosine is sqrt(2 - 2 cosine) long; in
one given direction of so many dimensions its extent is SIGMAS standard deviations of
that, length / sqrt(dimensions), at most, but for a share of about 6 in 100,000 of the pairs that
straddle a border.  With sigmas=None the whole length counts instead, and no pair can be missed,
at the cost of many more cells a vector.

Cosines are computed in cells by blocks of matrix products; a cell of more than LARGE vectors is
searched from vector to vector instead, each compared only with those not yet reached, which
gives the same groups.  Linked vectors form groups by connected components, and each group keeps
the vector with the least id.

Defined results: a null, empty or zero vector, one with a null or non-finite value or of another
length than most, is compared with nothing and kept; values may be of any magnitude; a null
vec_id has no identity and is left out of groups (dedup() keeps its row); rows repeated under one
vec_id are one vector when grouped; ties in the commonest length go to the shorter; an empty
table gives no rows; extra columns are not read, and kept by dedup().
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, small, written
from .simhash_dedup import local_roots

COSINE = 0.95
ROUNDS = 4
BLOCK = 1024
SIGMAS = 4.0
LARGE = 4096


def unit_vectors(col: pa.Array, dim: int) -> np.ndarray:
    v = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    v /= np.abs(v).max(axis=1, keepdims=True, initial=1e-300)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def _listed(v: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))


def nearest(v: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (v @ centers.T).argmax(axis=1)


def reach(cosine: float, dim: int, sigmas: float | None = SIGMAS) -> float:
    """How far from a border a vector still joins the cell beyond."""
    length = math.sqrt(max(0.0, 2 - 2 * cosine))
    return length / 2 * min(1.0, math.inf if sigmas is None else sigmas / math.sqrt(dim)) + 1e-4


def cells_of(v: np.ndarray, centers: np.ndarray, cosine: float, sigmas: float | None = SIGMAS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, whether it is the row's home) for the home and each cell whose border is near enough."""
    far = reach(cosine, v.shape[1], sigmas)
    sim = v @ centers.T
    home = sim.argmax(axis=1)
    short = sim[np.arange(len(v)), home][:, None] - sim
    row, cell = np.nonzero(short <= 2 * far + 1e-6)  # no two centres are farther apart than 2
    gap = np.linalg.norm(centers[home[row]] - centers[cell], axis=1)
    near = short[row, cell] <= far * gap + 1e-6
    row, cell = row[near], cell[near]
    return row, cell, cell == home[row]


def cell_pairs(v: np.ndarray, home: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one cell above the cosine, of which one at least is at home here."""
    mine, left, right = np.flatnonzero(home), [], []
    for a in range(0, len(mine), BLOCK):
        rows = mine[a : a + BLOCK]
        for b in range(0, len(v), BLOCK):
            x, y = np.nonzero(v[rows] @ v[b : b + BLOCK].T >= cosine)
            x, y = rows[x], y + b
            k = x != y
            left.append(x[k])
            right.append(y[k])
    z = np.zeros(0, np.int64)
    return np.concatenate(left or [z]), np.concatenate(right or [z])


def reached(v: np.ndarray, cosine: float, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(row, root row) of every row linked to another: the components of one cell, without all its pairs."""
    left, rows, roots = np.arange(len(v)), [], []
    while len(left):
        # Of the first few, those near nothing are done with; the next one begins a component.
        few = left[:block]
        links = (v[few] @ v[left].T >= cosine).sum(axis=1) > 1
        at = int(links.argmax()) if links.any() else len(few)
        left = left[at:]
        if at == len(few):
            continue
        root, left = left[0], left[1:]
        queue = np.array([root])
        while len(queue) and len(left):
            front, queue = queue[:block], queue[block:]
            near = np.flatnonzero((v[front] @ v[left].T >= cosine).any(axis=0))
            if len(near):
                rows.append(left[near])
                roots.append(np.full(len(near), root))
                queue = np.concatenate([queue, left[near]])
                left = np.delete(left, near)
    z = np.zeros(0, np.int64)
    return np.concatenate(rows or [z]), np.concatenate(roots or [z])


def _centers(vectors: DataFrame, k: int, dim: int, rounds: int, seed: int) -> np.ndarray:
    first = vectors.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(k).select("v").toArrow().column(0).combine_chunks()
    centers = unit_vectors(first, dim)
    for _ in range(rounds):
        sent = vectors.sparkSession.sparkContext.broadcast(centers)

        def part(batches, sent=sent):
            centers = sent.value
            total, count = np.zeros((len(centers), dim), np.float32), np.zeros(len(centers), np.int64)
            for b in batches:
                for v in _runs(unit_vectors(b.column(0), dim), len(centers)):
                    c = nearest(v, centers)
                    by = np.argsort(c, kind="stable")
                    edge = np.flatnonzero(np.r_[True, np.diff(c[by]) > 0])
                    total[c[by][edge]] += np.add.reduceat(v[by], edge, axis=0)
                    count += np.bincount(c, minlength=len(centers))
            used = np.flatnonzero(count)
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array(used), _listed(total[used])], ["cell", "total"])

        def whole(key, frame):
            return pd.DataFrame({"cell": [key[0]], "total": [np.sum(np.stack(frame["total"]), axis=0)]})

        sums = vectors.select("v").mapInArrow(part, "cell bigint, total array<float>").groupBy("cell").applyInPandas(whole, "cell bigint, total array<float>").toPandas()
        sent.destroy()
        centers = centers.copy()
        for cell, total in zip(sums["cell"], sums["total"]):
            n = np.linalg.norm(total)
            if n > 1e-9:
                centers[cell] = np.asarray(total) / n
    return centers


def _runs(v: np.ndarray, k: int):
    """v in runs of rows whose products with k centres stay under 64 MB."""
    step = max(1, (1 << 24) // max(k, 1))
    for lo in range(0, len(v), step):
        yield v[lo : lo + step]


def _usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that can be compared."""
    e = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("v"))
    return e.where("vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < float('inf')) and exists(v, x -> x <> 0)")


def assigned(one: DataFrame, centers: np.ndarray, dim: int, cosine: float = COSINE, sigmas: float | None = SIGMAS) -> DataFrame:
    """(cell, home, vec_id, v): every vector in its home cell, and in each other that it is near enough to."""
    sent = one.sparkSession.sparkContext.broadcast(centers)

    def assign(batches):
        centers = sent.value
        for b in batches:
            ids, at = b.column(0), 0
            for v in _runs(unit_vectors(b.column(1), dim), len(centers)):
                row, cell, home = cells_of(v, centers, cosine, sigmas)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(home), ids.take(pa.array(row + at)), _listed(v[row])], ["cell", "home", "vec_id", "v"])
                at += len(v)

    return one.select("vec_id", "v").mapInArrow(assign, "cell bigint, home boolean, vec_id bigint, v array<float>")


def groups(embeddings: DataFrame, cosine: float = COSINE, rounds: int = ROUNDS, seed: int = 42, sigmas: float | None = SIGMAS) -> DataFrame:
    """(vec_id, group_id, group_size, keep) for every vector with a near duplicate; group_id is the one kept."""
    e = _usable(embeddings)
    dims = e.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return e.selectExpr("vec_id", "vec_id as group_id", "1L as group_size", "true as keep")
    dim = dims["d"]
    e = e.where(F.size("v") == dim)
    one = written(e.groupBy("v").agg(F.min("vec_id").alias("vec_id")), "vectors")
    k = max(1, math.ceil(math.sqrt(one.count())))
    centers = _centers(one, k, dim, rounds, seed)

    def compare(batches):
        held: list[tuple] = []

        def pairs(rows):
            home, ids, v = (np.concatenate([r[i] for r in rows]) for i in (1, 2, 3))
            a, b = cell_pairs(v, home, cosine) if len(v) <= LARGE else reached(v, cosine)
            if len(a):
                node, root = local_roots(ids[a], ids[b])
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["a", "b"])

        for b in batches:
            cell = b.column(0).to_numpy(zero_copy_only=False)
            v = unit_vectors(b.column(3), dim)
            home, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            edge = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            for lo, hi in zip(edge, [*edge[1:], len(cell)]):
                if held and held[0][0] != cell[lo]:
                    yield from pairs(held)
                    held = []
                held.append((cell[lo], home[lo:hi], ids[lo:hi], v[lo:hi]))
        if held:
            yield from pairs(held)

    near = assigned(one, centers, dim, cosine, sigmas).repartition("cell").sortWithinPartitions("cell").mapInArrow(compare, "a bigint, b bigint")
    root = components(near)
    # Equal vectors are found again by two hashes of 64 bits each, so that none is shuffled for it.
    key = [F.xxhash64("v").alias("k0"), F.xxhash64(F.lit(1), "v").alias("k1")]
    first = one.select("vec_id", *key).join(root.withColumnRenamed("node", "vec_id"), "vec_id", "left").select("k0", "k1", F.coalesce("root", "vec_id").alias("group_id"))
    member = e.select("vec_id", *key).join(first, ["k0", "k1"]).select("vec_id", "group_id").distinct()
    sizes = member.groupBy("group_id").agg(F.count("*").alias("group_size")).where("group_size > 1")
    return member.join(sizes, "group_id").select("vec_id", "group_id", "group_size", (F.col("vec_id") == F.col("group_id")).alias("keep"))


def dedup(embeddings: DataFrame, cosine: float = COSINE, sigmas: float | None = SIGMAS) -> DataFrame:
    """embeddings without the vectors of each group that are not its kept one."""
    drop = small(written(groups(embeddings, cosine, sigmas=sigmas).where("not keep").select(F.col("vec_id").alias("_drop_id")).distinct(), "near-vectors"), 32)
    return embeddings.join(drop, embeddings["vec_id"] == drop["_drop_id"], "left_anti")
