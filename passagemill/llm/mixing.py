"""Operator 5: mixing overlapping sources to target weights by min-cost flow.

A document may belong to several sources.  Documents are aggregated by membership pattern; a
min-cost flow routes each pattern's tokens to the quotas of its sources, the first pass over a
pattern's tokens being free and each repetition dearer than the one before (convex costs).  The
flow is then turned into documents: a pattern's documents stand in a seeded order, and copies
of them fill its flow from the front.

A flow's ends cut that order in few places.  The order's running sums are taken over seeded
buckets, and within a bucket only where a cut falls, so no pattern is ever sorted; a document's
copies then follow from the cuts alone, and rows stream by without a shuffle.

Only the pattern table goes to the driver: at most a row for each set of the wanted sources, so
its size does not follow the documents'.

Defined results: documents without tokens (null and empty texts), without a doc_id or without
a wanted source are not selected; rows repeated under one doc_id are documents of their own, but
those with as many tokens too stand in one place and go together; an empty table gives no rows;
a quota that no capacity can fill stays short; texts of any length are counted whole; extra
columns are not read by mix() and kept by mixed_rows(), whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .shared import small, written

EPOCHS = 4
BUCKETS = 1024


def _spread(room: np.ndarray, amount: int) -> np.ndarray:
    """amount taken from the front of room."""
    return np.minimum(room, np.maximum(amount - (np.cumsum(room) - room), 0))


class Flow:
    """Tokens from patterns to sources.  member[p, x]: whether pattern p has source x; flow[p, x]: what it gives to it.

    Patterns outnumber sources by far, so paths are sought among the sources alone: flow can move
    from source x to y as far as patterns with both give to x.  One augmentation moves all that a
    shortest path of sources can carry, whatever the number of patterns on it, by whole columns.
    """

    def __init__(self, member: np.ndarray, quota: np.ndarray):
        self.member, self.left = member, quota.astype(np.int64)
        self.flow = np.zeros(member.shape, np.int64)

    def push(self, room: np.ndarray) -> None:
        """As much flow more as the quotas take, of at most room from each pattern; room is lessened by it."""
        m = self.member.shape[1]
        has = self.member.astype(np.float32)
        while True:
            enter = (room > 0).astype(np.float32) @ has
            move = (self.flow > 0).astype(np.float32).T @ has  # only whether it is zero counts
            via: dict[int, int | None] = {x: None for x in range(m) if enter[x] > 0}
            queue, end = list(via), None
            for x in queue:
                if self.left[x] > 0:
                    end = x
                    break
                for y in np.flatnonzero(move[x] > 0).tolist():
                    if y not in via:
                        via[y] = x
                        queue.append(y)
            if end is None:
                return
            path = [end]
            while via[path[-1]] is not None:
                path.append(via[path[-1]])
            path.reverse()
            carried = (int(self.flow[self.member[:, y] > 0, x].sum()) for x, y in zip(path, path[1:]))
            amount = min(int(room[self.member[:, path[0]] > 0].sum()), int(self.left[end]), *carried)
            for x, y in reversed(list(zip(path, path[1:]))):
                took = _spread(np.where(self.member[:, y] > 0, self.flow[:, x], 0), amount)
                self.flow[:, x] -= took
                self.flow[:, y] += took
            took = _spread(room * self.member[:, path[0]], amount)
            room -= took
            self.flow[:, path[0]] += took
            self.left[end] -= amount


def route(patterns: list[tuple[tuple[str, ...], int]], quotas: dict[str, int], epochs: int = EPOCHS) -> tuple[list[dict[str, int]], int]:
    """For each (sources, tokens) pattern the tokens it gives to each source, and the flow's cost.

    The r-th repetition of a token costs r: passes over the same text get dearer and dearer.
    Nothing else costs, so the cheapest augmenting path is any one into the cheapest pass that has
    one: passes are filled in turn, each to its maximum, which gives a maximum flow of least cost.
    """
    names = sorted(quotas)
    at = {x: i for i, x in enumerate(names)}
    member = np.zeros((len(patterns), len(names)), np.int64)
    for p, (sources, _) in enumerate(patterns):
        member[p, [at[x] for x in sources if x in at]] = 1
    tokens = np.array([t for _, t in patterns], np.int64)
    f, cost = Flow(member, np.array([quotas[x] for x in names], np.int64)), 0
    for r in range(epochs):
        room = tokens.copy()
        f.push(room)
        cost += r * int((tokens - room).sum())
    return [{names[x]: int(row[x]) for x in np.flatnonzero(row).tolist()} for row in f.flow], cost


def _counted(docs: DataFrame, members: Column, wanted: list[str], seed: int) -> list[Column]:
    """Columns of docs that place a document: doc_id, n_tokens, pattern, h (its place in the seeded order) and bucket."""
    names = F.array(*(F.lit(x) for x in sorted(wanted)))
    key = F.col("doc_id").cast("bigint")
    h = F.xxhash64(F.lit(seed), key)
    return [
        key.alias("doc_id"),
        F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("bigint").alias("n_tokens"),
        F.array_join(F.array_sort(F.array_intersect(F.coalesce(members, F.array().cast("array<string>")), names)), "\x1f").alias("pattern"),
        h.alias("h"),
        F.pmod(h, F.lit(BUCKETS)).cast("int").alias("bucket"),
    ]


def shares(counted: DataFrame, weights: dict[str, float], budget: float = 0.5, epochs: int = EPOCHS) -> DataFrame:
    """(pattern, takes) of the patterns that give anything: for each source the ends of its flow as cuts of the pattern's order.

    A cut is (pass, bucket, h, doc_id, n_tokens): the first document of that pass beyond it.
    """
    spark = counted.sparkSession
    sums = written(counted.where("doc_id is not null").groupBy("pattern", "bucket").agg(F.sum("n_tokens").alias("t")), "token-sums")
    total = sums.agg(F.coalesce(F.sum("t"), F.lit(0))).first()[0]
    pats = sums.where("pattern <> ''").groupBy("pattern").agg(F.sum("t").alias("t")).where("t > 0").orderBy("pattern").toPandas()
    unit = sum(weights.values())
    quotas = {x: int(total * budget * w / unit) for x, w in weights.items()}
    given, _ = route([(tuple(p.split("\x1f")), int(t)) for p, t in zip(pats["pattern"], pats["t"])], quotas, epochs)
    rows = []
    for p, t, g in zip(pats["pattern"], pats["t"], given):
        at = 0
        for x in sorted(g):
            rows += [(p, x, side, end // int(t), end % int(t)) for side, end in (("lo", at), ("hi", at + g[x]))]
            at += g[x]
    ends = spark.createDataFrame(rows, "pattern string, mix_source string, side string, pass bigint, place bigint")
    w = W.Window.partitionBy("pattern").orderBy("bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    before = sums.where("pattern <> '' and t > 0").select("pattern", "bucket", "t", F.coalesce(F.sum("t").over(w), F.lit(0)).alias("base"))
    cut = written(ends.join(before, "pattern").where("base <= place and place < base + t").drop("t"), "cuts")
    # Within the buckets that hold a cut: the first document whose middle is not before it.
    inner = counted.where("doc_id is not null and pattern <> '' and n_tokens > 0").join(small(cut.select("pattern", "bucket", "base").distinct(), F.octet_length("pattern") + 48), ["pattern", "bucket"])
    one = inner.groupBy("pattern", "bucket", "base", "h", "doc_id", "n_tokens").agg(F.count("*").alias("n"))
    run = W.Window.partitionBy("pattern", "bucket").orderBy("h", "doc_id", "n_tokens").rowsBetween(W.Window.unboundedPreceding, -1)
    size = F.col("n") * F.col("n_tokens")
    one = one.withColumn("middle", F.col("base") + F.coalesce(F.sum(size).over(run), F.lit(0)) + F.expr("(n * n_tokens) div 2")).drop("base")
    beyond = one.join(cut.select("pattern", "bucket", "place").distinct(), ["pattern", "bucket"]).where("middle >= place")
    first = beyond.groupBy("pattern", "bucket", "place").agg(F.min(F.struct("h", "doc_id", "n_tokens")).alias("k"))
    # A bucket without such a document is all before the cut: so is everything up to the next bucket.
    x = cut.join(first, ["pattern", "bucket", "place"], "left")
    at = F.struct("pass", F.when(F.col("k").isNull(), F.col("bucket") + 1).otherwise(F.col("bucket")).alias("bucket"), F.col("k.h").alias("h"), F.col("k.doc_id").alias("doc_id"), F.col("k.n_tokens").alias("n_tokens"))
    x = x.groupBy("pattern", "mix_source").pivot("side", ["lo", "hi"]).agg(F.first(at))
    return written(x.groupBy("pattern").agg(F.array_sort(F.collect_list(F.struct("mix_source", "lo", "hi"))).alias("takes")), "takes")


def _take(counted: DataFrame, weights: dict[str, float], budget: float, epochs: int, keep: list[str], narrow: DataFrame | None = None) -> DataFrame:
    """keep, mix_source and copies of every row of counted that is taken, once for each source that takes it; narrow: the placing columns alone."""
    takes = shares(narrow if narrow is not None else counted, weights, budget, epochs)
    takes = small(takes, F.octet_length("pattern") + 160 * F.size("takes"))
    x = counted.where("doc_id is not null and pattern <> '' and n_tokens > 0").join(takes, "pattern")
    here = F.struct("bucket", "h", "doc_id", "n_tokens")
    # Of the passes, those whose copy of this document lies before the cut.
    upto = lambda c: F.greatest(F.lit(0), F.least(F.lit(epochs), c["pass"] + (here < F.struct(c["bucket"], c["h"], c["doc_id"], c["n_tokens"])).cast("int")))
    copies = F.transform("takes", lambda t: F.struct(t["mix_source"].alias("mix_source"), (upto(t["hi"]) - upto(t["lo"])).cast("int").alias("copies")))
    return x.select(*keep, F.explode(F.filter(copies, lambda t: t["copies"] > 0)).alias("take")).select(*keep, "take.mix_source", "take.copies")


def mix(docs: DataFrame, members: Column, weights: dict[str, float], budget: float = 0.5, epochs: int = EPOCHS, seed: int = 42) -> DataFrame:
    """(doc_id, mix_source, copies, n_tokens): what to take, for budget times the corpus's tokens.

    members: an array of source names.  weights: the share of each wanted source, in any unit.
    """
    counted = written(docs.select(*_counted(docs, members, list(weights), seed)), "tokens")
    return _take(counted, weights, budget, epochs, ["doc_id", "n_tokens"]).select("doc_id", "mix_source", "copies", "n_tokens")


def mixed_rows(docs: DataFrame, members: Column, weights: dict[str, float], budget: float = 0.5, epochs: int = EPOCHS, seed: int = 42) -> DataFrame:
    """The taken rows of docs with all their columns, and mix_source, copies and n_tokens."""
    clash = {"mix_source", "copies", "n_tokens"} & set(docs.columns)
    if clash:
        raise ValueError(f"rename {sorted(clash)}")
    columns = _counted(docs, members, list(weights), seed)
    counted = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *columns)
    narrow = written(docs.select(*columns), "tokens")
    return _take(counted, weights, budget, epochs, ["row", "n_tokens"], narrow).select("row.*", "mix_source", "copies", "n_tokens")


#: Shares of the production mix: languages, and long documents of whatever language as a source of their own.
WEIGHTS = {"lang:en": 0.45, "lang:de": 0.15, "lang:fr": 0.15, "lang:es": 0.1, "long": 0.15}


def document_sources() -> Column:
    """The sources a row of documents belongs to: its language's, and "long" from 8,000 characters."""
    return F.array_compact(F.array(F.concat(F.lit("lang:"), "lang"), F.when(F.col("n_chars") >= 8000, F.lit("long"))))


def mix_documents(docs: DataFrame) -> DataFrame:
    return mix(docs, document_sources(), WEIGHTS)


def mixed_documents(docs: DataFrame) -> DataFrame:
    return mixed_rows(docs, document_sources(), WEIGHTS)
