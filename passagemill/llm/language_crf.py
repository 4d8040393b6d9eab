"""Operator 10: language identification by a linear-chain conditional random field over words.

Every word's emission comes from hashed affix and n-gram features and from lexicon features;
transitions between the languages of neighbouring words are learned with them, on sequences
that switch language.  Forward-backward gives each word's posterior; a document's language is
the one with the most posterior mass.

Training fits on a bounded sample: the sample_rows labelled rows with the least seeded hash of
doc_id (a parameter).  All counts below are over whole texts of all rows.

Defined results: a document without a word of letters, a null text included, is rejected with
a null language; so is one whose words are labelled with a mean certainty under min_certainty.
Rows with equal doc_ids, or with a null one, are labelled each for itself.  With no labelled
row there are no languages and every document is rejected.  Texts of any length are labelled
whole; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn

BUCKETS = 1 << 14
SAMPLE_ROWS = 240
LEXICON = 400
MIN_CERTAINTY = 0.5
_BLOCK = 64

_LETTER = tn.WORD.copy()
for _c in b"0123456789_":
    _LETTER[_c] = False


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # (BUCKETS + languages + 1, languages): hashed features, lexicons, bias
    transitions: np.ndarray
    start: np.ndarray
    lexicon: np.ndarray  # sorted word hashes
    lexicon_in: np.ndarray  # (words, languages) membership


def letter_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    s, e, d = tn.tokens(buf, off)
    acc = np.concatenate([[0], np.cumsum(_LETTER[buf])])
    k = acc[e] > acc[s]
    return s[k], e[k], d[k]


def features(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word index, feature) pairs, in no order: affixes of one to three bytes, 2-grams and 3-grams."""
    n = e - s
    who, what = [], []

    def add(w: np.ndarray, code: np.ndarray, kind: int) -> None:
        who.append(w)
        what.append((tn.mix(code.astype(np.uint64), kind) % np.uint64(BUCKETS)).astype(np.int64))

    b = buf.astype(np.int64)
    for k in (1, 2, 3):
        w = np.flatnonzero(n >= k)
        pre, suf = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)
        for i in range(k):
            pre = pre * 257 + b[s[w] + i]
            suf = suf * 257 + b[e[w] - k + i]
        add(w, pre, k)
        add(w, suf, 10 + k)
    for k in (2, 3):
        many = np.maximum(n - k + 1, 0)
        w = np.repeat(np.arange(len(s)), many)
        at = np.arange(len(w)) - np.repeat(np.cumsum(many) - many, many) + s[w]
        code = np.zeros(len(w), np.int64)
        for i in range(k):
            code = code * 257 + b[at + i]
        add(w, code, 20 + k)
    return np.concatenate(who), np.concatenate(what)


def emissions(model: Model, buf: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Log-potential of each language for every word; computed once for each distinct word."""
    _, first, back = np.unique(h, return_index=True, return_inverse=True)
    who, what = features(buf, s[first], e[first])
    k = len(model.languages)
    out = np.empty((len(first), k))
    for j in range(k):
        out[:, j] = np.bincount(who, model.weights[what, j], len(first))
    out += model.weights[-1]
    if len(model.lexicon):
        at = np.minimum(np.searchsorted(model.lexicon, h[first]), len(model.lexicon) - 1)
        hit = np.flatnonzero(model.lexicon[at] == h[first])
        out[hit] += model.lexicon_in[at[hit]] @ model.weights[BUCKETS : BUCKETS + k]
    return out[back]


def forward_backward(emit: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (n, K) and expected transition counts (K, K) of a run of sequences; first marks where each begins.

    Blocks of words advance side by side: products of their transition matrices carry the state
    from block to block, so the result is exact however long a sequence is.
    """
    n, k = emit.shape
    if n == 0:
        return np.zeros((0, k)), np.zeros((k, k))
    t = np.exp(trans)
    pi = np.exp(start - start.max())
    pi /= pi.sum()
    pad = -n % _BLOCK
    em = np.ones((n + pad, k))
    em[:n] = np.exp(emit - emit.max(axis=1, keepdims=True))
    st = np.ones(n + pad, bool)  # what pads the last block begins anew, so nothing flows back from it
    st[:n] = first
    st[0] = True
    em, st = em.reshape(-1, _BLOCK, k), st.reshape(-1, _BLOCK)
    blocks = len(em)
    prod = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for i in range(_BLOCK):
        q = (prod.reshape(-1, k) @ t).reshape(blocks, k, k)
        r = st[:, i]
        if r.any():
            q[r] = prod[r].sum(axis=2, keepdims=True) * pi
        prod = q * em[:, i, None, :]
        prod /= prod.max(axis=(1, 2), keepdims=True)
    into, back = np.empty((blocks, k)), np.empty((blocks, k))
    v, w = np.full(k, 1 / k), np.full(k, 1 / k)
    for i in range(blocks):
        into[i] = v
        v = v @ prod[i]
        v /= v.sum()
        back[blocks - 1 - i] = w
        w = prod[blocks - 1 - i] @ w
        w /= w.sum()
    alpha, beta = np.empty_like(em), np.empty_like(em)
    a = into
    for i in range(_BLOCK):
        a = np.where(st[:, i, None], pi, a @ t) * em[:, i]
        a /= a.sum(axis=1, keepdims=True)
        alpha[:, i] = a
    b = back
    for i in range(_BLOCK - 1, -1, -1):
        beta[:, i] = b
        b = np.where(st[:, i, None], 1.0, (em[:, i] * b) @ t.T)
        b /= b.sum(axis=1, keepdims=True)
    alpha, beta, em, st = alpha.reshape(-1, k)[:n], beta.reshape(-1, k)[:n], em.reshape(-1, k)[:n], st.ravel()[:n]
    post = alpha * beta
    post /= post.sum(axis=1, keepdims=True)
    c = np.flatnonzero(~st[1:]) + 1
    x, y = alpha[c - 1], em[c] * beta[c]
    z = ((x @ t) * y).sum(axis=1, keepdims=True)
    return post, t * ((x / z).T @ y)


def train(rows: list[tuple[str, str]], seed: int = 7, rounds: int = 40, switch: float = 0.05) -> Model:
    """Fit on (language, text) rows; training sequences are pieces of the rows, put together so that they switch."""
    rows = [(lang, text.lower()) for lang, text in rows if lang and text]
    langs = tuple(sorted({lang for lang, _ in rows}))
    k = len(langs)
    weights = np.zeros((BUCKETS + k + 1, k))
    if not rows:
        return Model((), weights, np.zeros((0, 0)), np.zeros(0), np.zeros(0, np.uint64), np.zeros((0, 0)))
    buf, off = tn.raw(pa.array([text for _, text in rows], pa.string()))
    s, e, d = letter_words(buf, off)
    if not len(s):
        return Model((), weights[:, :0], np.zeros((0, 0)), np.zeros(0), np.zeros(0, np.uint64), np.zeros((0, 0)))
    label = np.array([langs.index(lang) for lang, _ in rows])[d]
    h = tn.span_hash(buf, s, e)
    vocab, back = np.unique(h, return_inverse=True)
    freq = np.zeros((len(vocab), k))
    np.add.at(freq, (back, label), 1)
    # A word is in a language's lexicon if it is among its most frequent and mostly its own.
    inside = np.zeros((len(vocab), k), bool)
    own = freq / freq.sum(axis=1, keepdims=True)
    for j in range(k):
        top = np.argsort(-freq[:, j], kind="stable")[:LEXICON]
        inside[top, j] = (freq[top, j] > 1) & (own[top, j] > 0.5)
    kept = inside.any(axis=1)
    lexicon, lexicon_in = vocab[kept], inside[kept].astype(float)

    rng = np.random.default_rng(seed)
    cut = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (rng.random(len(d) - 1) < switch)])
    piece = np.split(np.arange(len(d)), cut[1:])
    order = np.concatenate([piece[i] for i in rng.permutation(len(piece))])
    label, first = label[order], np.zeros(len(order), bool)
    first[:: 40] = True
    _, example = np.unique(h, return_index=True)
    who, what = features(buf, s[example], e[example])
    mine = back[order]
    trans, start = np.zeros((k, k)), np.zeros(k)
    lex = np.where(kept)[0]
    square = [np.full_like(weights, 1e-6), np.full_like(trans, 1e-6)]
    gold = np.zeros((len(order), k))
    gold[np.arange(len(order)), label] = 1
    c = np.flatnonzero(~first[1:]) + 1
    pairs = np.zeros((k, k))
    np.add.at(pairs, (label[c - 1], label[c]), 1)
    for _ in range(rounds):
        emit = np.stack([np.bincount(who, weights[what, j], len(vocab)) for j in range(k)], axis=1) + weights[-1]
        emit[lex] += lexicon_in @ weights[BUCKETS : BUCKETS + k]
        post, soft = forward_backward(emit[mine], first, trans, start)
        err = np.stack([np.bincount(mine, (gold - post)[:, j], len(vocab)) for j in range(k)], axis=1)
        g = np.zeros_like(weights)
        for j in range(k):
            g[:BUCKETS, j] = np.bincount(what, err[who, j], BUCKETS)
        g[BUCKETS : BUCKETS + k] = lexicon_in.T @ err[lex]
        g[-1] = err.sum(axis=0)
        for x, grad, sq, rate in ((weights, g / len(order) - 1e-6 * weights, square[0], 0.2), (trans, (pairs - soft) / len(order), square[1], 0.2)):
            sq += grad * grad
            x += rate * grad / np.sqrt(sq)
    return Model(langs, weights.astype(np.float32), trans, start, lexicon, lexicon_in)


def label_rows(model: Model, texts: pa.Array, min_certainty: float = MIN_CERTAINTY):
    """Per slice of rows: (first row, columns) with the columns of identify() but for doc_id."""
    k = len(model.languages)
    names = np.array([*model.languages, None], object)
    for lo, hi, buf, off in tn.slices(texts):
        n = hi - lo
        s, e, d = letter_words(buf, off)
        count = np.bincount(d, minlength=n).astype(np.int32)
        if k and len(s):
            emit = emissions(model, buf, s, e, tn.span_hash(buf, s, e))
            first = np.r_[True, d[1:] != d[:-1]]
            post, _ = forward_backward(emit, first, model.transitions, model.start)
            mass = np.stack([np.bincount(d, post[:, j], n) for j in range(k)], axis=1)
            sure = np.bincount(d, post.max(axis=1), n) / np.maximum(count, 1)
            best = post.argmax(axis=1)
            turn = np.bincount(d[1:], (best[1:] != best[:-1]) & ~first[1:], n).astype(np.int32)
            lang = np.where(count > 0, mass.argmax(axis=1), k)
            share = mass.max(axis=1) / np.maximum(count, 1)
        else:
            lang, share, sure, turn = np.full(n, k), np.zeros(n), np.zeros(n), np.zeros(n, np.int32)
        reject = (lang == k) | (sure < min_certainty)
        yield lo, [names[lang], share, sure, count, turn, reject]


OUT = "doc_id bigint, pred_lang string, share double, certainty double, n_words int, n_switches int, rejected boolean"


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 42) -> Model:
    """The model of the sample.  Its last hash is found among ids alone; then only its texts are fetched."""
    known = docs.where("lang is not null and text is not null and doc_id is not null")
    h = F.xxhash64(F.lit(seed), F.col("doc_id").cast("bigint"))
    last = known.select(h.alias("h")).orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    if last is None:
        return train([])
    rows = known.where(h <= last).select("lang", "text", h.alias("h")).orderBy("h", "lang", "text").limit(sample_rows)
    return train([(r["lang"], r["text"]) for r in rows.collect()])


def identify(docs: DataFrame, model: Model | None = None, min_certainty: float = MIN_CERTAINTY) -> DataFrame:
    """One row for each document: its language, the share and certainty of it, its words and its switches."""
    model = model or fit(docs)

    def run(batches):
        for b in batches:
            for lo, cols in label_rows(model, tn.column(b, "text", lower=True), min_certainty):
                types = [pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.bool_()]
                made = [pa.array(c, t) for c, t in zip(cols, types)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(cols[0])), *made], ["doc_id", "pred_lang", "share", "certainty", "n_words", "n_switches", "rejected"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, OUT)


def keep_identified(docs: DataFrame, model: Model | None = None, min_certainty: float = MIN_CERTAINTY) -> DataFrame:
    """docs without the documents that identify() rejects; those kept without a lang get the one identified.

    The verdict is made as the rows stream by, without a join.
    """
    model = model or fit(docs)
    at, lang = docs.columns.index("text"), docs.columns.index("lang") if "lang" in docs.columns else None

    def run(batches):
        for b in batches:
            made = [cols for _, cols in label_rows(model, tn.column(b, b.schema.names[at], lower=True), min_certainty)]
            if made:
                ok = pa.array(np.concatenate([~c[5] for c in made]))
                if lang is not None:
                    pred = pa.array(np.concatenate([c[0] for c in made]), b.column(lang).type)
                    b = b.set_column(lang, b.schema.field(lang), pc.coalesce(b.column(lang), pred))
                yield b.filter(ok)

    return docs.mapInArrow(run, docs.schema)
