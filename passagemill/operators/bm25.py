"""Full-text search: stored postings and BM25.

An index is a table of postings by shards of passages, a table of terms with their document
frequencies, and two numbers.  A shard is made where its passages lie, in one pass over their
texts and without a shuffle: a row lists the passages of one term by their places in the shard,
and one row of the shard lists its passages.  A search reads only the asked terms' rows.
Shard by shard their weights are added up in a small matrix of questions by passages; a task
keeps the best few of each question over all of its shards, and a window merges those of the
tasks.  No pair of a question and a passage becomes a row, but for scoped searches, whose pairs
are given.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from passagemill.functions.text import tokens
from passagemill.functions.vectors import Best, first_k, pieces, split_words
from passagemill.tables import small, written

K1, B = 1.2, 0.75
SHARD_ROWS = 4096
#: Pairs of a question and a term that are broadcast at once; more questions go in blocks.
ASKED = 1 << 20
BROADCAST = 32 << 20
#: Terms up to which the scan itself filters.
LISTED = 10_000
_CELLS = 1 << 22
#: Pairs of questions and passages up to which a term's are listed; those of a commoner one are added as a block.
_LISTED_PAIRS = 512


@dataclass(frozen=True)
class Index:
    """postings (shard, term, at, tf, ids), terms (term, df), and the passages' number and mean length in tokens.

    A row of postings has a term's passages, at their places in the shard, and how often they
    hold it; the row of a shard without a term has the passages' ids, and at their lengths.
    """

    postings: DataFrame
    terms: DataFrame
    n_docs: int
    avg_len: float


def _counts(texts: pa.Array):
    """(row, word number, times) of each row's distinct tokens, the words, and the rows' lengths in tokens."""
    row, code, words = split_words(texts)
    dl = np.bincount(row, minlength=len(texts)).astype(np.int32)
    at, tf = np.unique(row * max(len(words), 1) + code, return_counts=True)
    return at // max(len(words), 1), at % max(len(words), 1), tf.astype(np.int32), words, dl


def _counted(key: str):
    def run(batches):
        for whole in batches:
            for b in pieces(whole, whole.column(1)):
                row, code, tf, words, dl = _counts(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), words.take(pa.array(code)), pa.array(tf), pa.array(dl[row])], [key, "term", "tf", "dl"])

    return run


def _summed(batches):
    for whole in batches:
        for b in pieces(whole, whole.column(0)):
            _, code, tf, words, _ = _counts(b.column(0))
            docs = np.bincount(code, minlength=len(words))
            yield pa.RecordBatch.from_arrays([words, pa.array(docs), pa.array(np.bincount(code, tf, len(words)).astype(np.int64))], ["term", "n_docs", "n"])


def postings(chunks: DataFrame, key: str = "id", unique: bool = False) -> DataFrame:
    """(key, term, tf, dl): how often each passage holds a term, and the passage's length in tokens.

    unique: no two rows have a key in common, so that rows are counted where they lie.
    """
    kind = T.StructType([T.StructField(key, chunks.schema[key].dataType), T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType()), T.StructField("dl", T.IntegerType())])
    p = chunks.select(key, F.lower("text").alias("text")).mapInArrow(_counted(key), kind)
    return p if unique else p.groupBy(key, "term").agg(F.sum("tf").cast("int").alias("tf"), F.first("dl").alias("dl"))


def term_totals(chunks: DataFrame, key: str = "id") -> DataFrame:
    """(term, n_docs, n): how many passages hold a term, and how often."""
    if not has_unique(chunks, key):
        p = postings(chunks, key)
        return p.groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("n"))
    part = chunks.select(F.lower("text").alias("text")).mapInArrow(_summed, "term string, n_docs bigint, n bigint")
    return part.groupBy("term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n"))


def has_unique(df: DataFrame, key: str) -> bool:
    n, distinct = df.agg(F.count("*"), F.count_distinct(key)).first()
    return n == distinct


def _sharding(rows: int, names: list[str], id_type: pa.DataType | None = None):
    def lists(edge: np.ndarray, values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(values.astype(np.int32)))

    def made(held, shard: int):
        ids = pa.concat_arrays([h[0] for h in held])
        words = pa.chunked_array([h[4] for h in held]).combine_chunks().dictionary_encode()
        number, passed, codes, at = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), 0, [], []
        before = 0
        for h in held:
            codes.append(number[passed + h[2]])
            at.append(h[1] + before)
            passed, before = passed + len(h[4]), before + len(h[0])
        code, at, tf = np.concatenate(codes), np.concatenate(at), np.concatenate([h[3] for h in held])
        by = np.argsort(code, kind="stable")
        code, at, tf = code[by], at[by], tf[by]
        edge = np.flatnonzero(np.r_[True, code[1:] != code[:-1], True]) if len(code) else np.zeros(1, np.int64)
        terms, dl = words.dictionary.take(pa.array(code[edge[:-1]])), np.concatenate([h[5] for h in held])
        n = len(terms)
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([None], pa.string()), lists(np.array([0, len(ids)]), dl), pa.array([None], pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)], names)
        for lo in range(0, n, 8192):
            e = edge[lo : min(lo + 8192, n) + 1]
            m = len(e) - 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, shard)), terms.slice(lo, m), lists(e - e[0], at[e[0] : e[-1]]), lists(e - e[0], tf[e[0] : e[-1]]), pa.nulls(m, pa.list_(ids.type))], names)

    def run(batches):
        from pyspark import TaskContext

        held, n, shard = [], 0, TaskContext.get().partitionId() << 20
        for whole in batches:
            for lo in range(0, whole.num_rows, rows):
                part = whole.slice(lo, rows)
                for b in pieces(part, part.column(1)):
                    if n and n + b.num_rows > rows:
                        yield from made(held, shard)
                        held, n, shard = [], 0, shard + 1
                    row, code, tf, words, dl = _counts(b.column(1))
                    held.append((b.column(0), row, code, tf, words, dl))
                    n += b.num_rows
        if held:
            yield from made(held, shard)

    return run


def sharded(chunks: DataFrame, key: str = "id") -> DataFrame:
    """An index's postings, by shards of up to SHARD_ROWS passages of one partition; passages of one key count as one."""
    x = chunks.select(key, F.lower("text").alias("text"))
    if not has_unique(chunks, key):
        x = x.groupBy(key).agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))
    kind = T.ArrayType(T.IntegerType())
    out = T.StructType([T.StructField("shard", T.LongType()), T.StructField("term", T.StringType()), T.StructField("at", kind), T.StructField("tf", kind), T.StructField("ids", T.ArrayType(chunks.schema[key].dataType))])
    return x.mapInArrow(_sharding(SHARD_ROWS, out.names), out)


def term_counts(p: DataFrame) -> DataFrame:
    return p.where("term is not null").groupBy("term").agg(F.sum(F.size("at")).cast("bigint").alias("df"))


def numbers(p: DataFrame) -> tuple[int, float]:
    """How many passages have a token, and how many tokens they have on average."""
    long = F.aggregate("at", F.lit(0).cast("bigint"), lambda a, x: a + x)
    some = F.size(F.filter("at", lambda x: x > 0))
    n, total = p.where("term is null").agg(F.coalesce(F.sum(some), F.lit(0)), F.coalesce(F.sum(long), F.lit(0))).first()
    return n, total / max(n, 1)


def index(chunks: DataFrame, key: str = "id") -> Index:
    """An index in the shared folder, for chunks that have no stored one."""
    p = written(sharded(chunks, key), "postings")
    return Index(p, written(term_counts(p), "terms"), *numbers(p))


def query_terms(questions: DataFrame, qid: str = "qid", text: str = "question") -> DataFrame:
    return questions.select(qid, F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))


def score(source: Index | DataFrame, questions: DataFrame, scope: DataFrame, key: str = "id") -> DataFrame:
    """(qid, key, score) of those pairs of scope (qid, key) that share a term; frequencies and lengths are those of all passages."""
    ix = source if isinstance(source, Index) else index(source, key)
    passages = ix.postings.where("term is null").select("shard", F.posexplode(F.arrays_zip("ids", F.col("at").alias("dl"))).alias("at", "x")).select("shard", "at", F.col("x.ids").alias(key), "x.dl")
    placed = passages.join(small(scope.select("qid", key).distinct(), 128), key)
    pairs = written(query_terms(questions).join(placed, "qid"), "scoped")
    held = ix.postings.where("term is not null").join(small(pairs.select("shard", "term").distinct(), 64), ["shard", "term"], "left_semi")
    held = held.select("shard", "term", F.explode(F.arrays_zip("at", "tf")).alias("x")).select("shard", "term", "x.at", "x.tf")
    x = pairs.join(held, ["shard", "term", "at"]).join(ix.terms, "term")
    idf = F.log(1 + (ix.n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / max(ix.avg_len, 1e-9)))
    return x.groupBy("qid", key).agg(F.round(F.sum(weight), 6).alias("score"))


def _kernel(sent, k: int, names: list[str], avg_len: float):
    def shard(best: Best, asked: dict, ids: pa.Array, dl: np.ndarray, terms: list[tuple]) -> None:
        order = pc.array_sort_indices(ids).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        by_key = ids.take(pa.array(order))
        scaled = K1 * (1 - B + B * dl / avg_len)
        rows, listed = [], [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for t, at, tf in sorted(terms, key=lambda x: x[0]):
            q = asked["questions"][asked["start"][t] : asked["start"][t + 1]]
            at, w = place[at], asked["idf"][t] * tf * (K1 + 1) / (tf + scaled[at])
            if len(q) * len(at) > _LISTED_PAIRS:
                rows.append((q, at, w))
            else:
                listed.append((np.repeat(q, len(at)), np.tile(at, len(q)), np.tile(w, len(q))))
        one_q, one_at, one_w = (np.concatenate(x) for x in zip(*listed))
        by = np.argsort(one_q, kind="stable")
        one_q, one_at, one_w = one_q[by], one_at[by], one_w[by]
        step = max(1, _CELLS // len(order))
        for lo in range(0, asked["n"], step):
            hi = min(asked["n"], lo + step)
            s = np.zeros((hi - lo, len(order)))
            for q, at, w in rows:
                a, b = np.searchsorted(q, (lo, hi))
                if b > a:
                    s[(q[a:b] - lo)[:, None], at] += w
            a, b = np.searchsorted(one_q, (lo, hi))
            np.add.at(s.reshape(-1), (one_q[a:b] - lo) * len(order) + one_at[a:b], one_w[a:b])
            most = best.most[lo:hi]
            known = most < np.finfo(float).max
            if known.all():
                q, j = np.divmod(np.flatnonzero(s >= np.maximum(-most - 6e-7, 1e-300)[:, None]), len(order))
            else:
                q, j = first_k(-np.round(s, 6), k, s > 0)
            best.add(q + lo, -np.round(s[q, j], 6), j, by_key)

    def run(batches):
        asked = sent.value
        best, held, now = Best(asked["n"], k), {}, None
        ids, terms = None, []
        for b in batches:
            at = b.column(0).to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.r_[True, at[1:] != at[:-1], True]) if len(at) else []
            for lo, hi in zip(edge[:-1], edge[1:]):
                if at[lo] != now and ids is not None:
                    shard(best, asked, ids, dl, terms)
                    best.cut()
                if at[lo] != now:
                    now, ids, terms = at[lo], None, []
                part = b.slice(lo, hi - lo)
                off, places, tfs = part.column(2).offsets.to_numpy(), part.column(2).flatten().to_numpy(zero_copy_only=False), part.column(3).flatten().to_numpy(zero_copy_only=False).astype(float)
                off = off - off[0]
                before = 0  # a shard's own row has no frequencies
                for i, t in enumerate(part.column(1).to_pylist()):
                    x, y = off[i], off[i + 1]
                    if t < 0:
                        ids, dl, before = part.column(4)[i].values, places[x:y].astype(float), before + y - x
                    else:
                        terms.append((t, places[x:y], tfs[x - before : y - before]))
        if ids is not None:
            shard(best, asked, ids, dl, terms)
        q, value, at, keys = best.cut()
        if len(q):
            yield pa.RecordBatch.from_arrays([asked["qids"].take(pa.array(q)), keys.take(pa.array(at)), pa.array(-value)], names)

    return run


def _block(ix: Index, asked: DataFrame, k: int, qid: str, key: str) -> DataFrame:
    """The best k of every shard for the questions of one block of (qid, term)."""
    spark = asked.sparkSession
    rows = asked.where(F.col(qid).isNotNull()).toArrow()
    qids = rows.column(0).combine_chunks().dictionary_encode() if rows.num_rows else pa.array([], rows.schema.field(0).type).dictionary_encode()
    words = sorted(set(rows.column(1).to_pylist()))
    wanted = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "term string, number int")
    if sum(map(len, words)) * 4 + 32 * len(words) <= BROADCAST:
        wanted = F.broadcast(wanted)
    known = {r["number"]: r["df"] for r in ix.terms.join(wanted, "term").collect()}
    number = {w: i for i, w in enumerate(words)}
    term = np.array([number[w] for w in rows.column(1).to_pylist()], np.int64)
    q = qids.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    by = np.lexsort((q, term))
    df = np.array([known.get(i, 0) for i in range(len(words))], float)
    sent = spark.sparkContext.broadcast(
        {
            "n": len(qids.dictionary), "qids": qids.dictionary, "questions": q[by], "start": np.searchsorted(term[by], np.arange(len(words) + 1)),
            "idf": np.log(1 + (ix.n_docs - df + 0.5) / (df + 0.5)),
        }
    )
    p = ix.postings.where(F.col("term").isin(words)) if len(words) <= LISTED else ix.postings.where("term is not null")
    cols = ["shard", "number", "at", "tf", "ids"]
    p = p.join(wanted, "term").select(*cols).unionByName(ix.postings.where("term is null").withColumn("number", F.lit(-1)).select(*cols))
    out = T.StructType([T.StructField(qid, asked.schema[qid].dataType), T.StructField(key, ix.postings.schema["ids"].dataType.elementType), T.StructField("score", T.DoubleType())])
    # As many tasks as cores: each has the best of every question once.
    tasks = asked.sparkSession.sparkContext.defaultParallelism
    return p.repartition(tasks, "shard").sortWithinPartitions("shard", "number").mapInArrow(_kernel(sent, k, out.names, max(ix.avg_len, 1e-9)), out)


def search(source: Index | DataFrame, questions: DataFrame, k: int, key: str = "id", scope: DataFrame | None = None, block: int = ASKED) -> DataFrame:
    """(qid, key, score, rank) of the k best passages of each question, of scope's (qid, key) pairs if given; ties go by key."""
    best = W.Window.partitionBy("qid").orderBy(F.desc("score"), key)
    ix = source if isinstance(source, Index) else index(source, key)
    if scope is not None:
        return score(ix, questions, scope, key).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    asked = query_terms(questions).distinct()
    blocks = max(1, -(-asked.count() // block))
    found = None
    for b in range(blocks):
        part = _block(ix, asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b) if blocks > 1 else asked, k, "qid", key)
        found = part if found is None else found.unionByName(part)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
