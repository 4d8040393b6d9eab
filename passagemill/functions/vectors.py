"""Vectors as Column expressions, in double precision whatever the stored type."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:
    from _md5 import md5 as _md5  # for short words several times as fast as OpenSSL's
except ImportError:
    _md5 = hashlib.md5


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once: an expression named twice in a lambda is evaluated twice, and for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unit(a: Column) -> Column:
    return let(norm(a), lambda n: F.transform(a, lambda x: x.cast("double") / n))


def joined(tokens: Column) -> Column:
    """Tokens as one text, which goes to Python faster than an array of them; split_rows takes it apart."""
    return F.array_join(tokens, " ")


def split_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, word number) of every token of joined texts, and the distinct words by number."""
    lists = pc.split_pattern(texts, " ")
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    words = lists.flatten().dictionary_encode()
    row, code = np.repeat(np.arange(len(texts)), size), words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.index_in(pa.scalar(""), value_set=words.dictionary).as_py()
    keep = slice(None) if empty is None else code != empty
    return row[keep], code[keep], words.dictionary


#: Code points from here on are neither letters nor digits.
_LAST = 0x3FFFF
_alnum: list[np.ndarray] = []
#: Bytes of text that are taken apart at once.
PIECE_BYTES = 2 << 20
LONGEST_TOKEN = 40


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, word number) of every search token of lower-case texts, and the distinct words by number: runs of letters and digits of up to 40 characters."""
    if not _alnum:
        _alnum.append(np.fromiter((unicodedata.category(chr(i))[0] in "LN" for i in range(_LAST + 1)), bool))
    held = [t or "" for t in texts.to_pylist()]
    u = np.frombuffer("\n".join(held).encode("utf-32-le", "replace"), np.uint32)
    first = np.cumsum(np.array([0, *map(len, held)], np.int64)[:-1] + 1) - 1
    ok = _alnum[0][np.minimum(u, _LAST)]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], ok.view(np.int8), [0])).astype(np.int8)))
    lo, hi = edge[::2], edge[1::2]
    long = hi - lo > LONGEST_TOKEN
    if long.any():
        for a, b in zip(lo[long], hi[long]):
            ok[a:b] = False
        lo, hi = lo[~long], hi[~long]
    signs = u[ok]
    end = np.cumsum(1 + (signs > 0x7F) + (signs > 0x7FF) + (signs > 0xFFFF), dtype=np.int64)
    off = np.concatenate(([0], end[np.cumsum(hi - lo) - 1])).astype(np.int32)
    words = pa.StringArray.from_buffers(len(lo), pa.py_buffer(off), pa.py_buffer(signs.tobytes().decode("utf-32-le").encode())).dictionary_encode()
    return np.searchsorted(first, lo, side="right") - 1, words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary


def pieces(b: pa.RecordBatch | pa.Array, texts: pa.Array, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch | pa.Array]:
    """A batch in runs of rows of bounded bytes of text, of one row at least."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).cumsum(dtype=np.int64)
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most, side="right")))
        yield b.slice(lo, hi - lo)
        lo = hi


#: Places of words met before, of so many at most in a worker.
_KNOWN = 1 << 18
_known: dict[str, int] = {}


def _hash(word: str) -> int:
    h = _known.get(word)
    if h is None:
        h = int.from_bytes(_md5(word.encode()).digest()[:4], "big")
        if len(_known) < _KNOWN:
            _known[word] = h
    return h


def _bags(row: np.ndarray, code: np.ndarray, words: pa.Array, texts: pa.Array, n: int) -> pa.Array:
    place = np.fromiter(map(_hash, words.to_pylist()), np.int64, len(words)) % n
    counts = np.bincount(row * n + place[code], minlength=len(texts) * n).reshape(len(texts), n).astype(np.float64)
    counts /= np.maximum(np.sqrt((counts * counts).sum(axis=1, keepdims=True)), 1e-300)
    off = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * n, mask=np.r_[np.asarray(texts.is_null()), False] if texts.null_count else None)
    return pa.ListArray.from_arrays(off, pa.array(counts.ravel()))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _hashed(texts: pa.Array, dims: pa.Array) -> pa.Array:
    return _bags(*split_rows(texts), texts, dims[0].as_py() if len(dims) else 1)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _hashed_text(texts: pa.Array, dims: pa.Array) -> pa.Array:
    n = dims[0].as_py() if len(dims) else 1
    return pa.concat_arrays([pa.array([], pa.list_(pa.float64())), *(_bags(*split_words(x), x, n) for x in pieces(texts, texts))])


def hashed_words(tokens: Column, dims: int = 64) -> Column:
    """A bag of words by feature hashing, of unit length (zero if there are no tokens, null for null): the offline stand-in for a neural embedding."""
    return _hashed(joined(tokens), F.lit(dims))


def hashed_text(text: Column, dims: int = 64) -> Column:
    """hashed_words() of a text's search tokens, which Python takes apart faster than an expression does."""
    return _hashed_text(F.lower(text), F.lit(dims))


class Best:
    """The k least values of each of n queries, ties by key, of what is added bit by bit; most has the last kept value of each query, once it is known."""

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k = n, k
        self.most = np.full(n, np.finfo(float).max)
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.keys: list[pa.Array] = []
        self.held, self.n_keys = 0, 0

    def add(self, q: np.ndarray, value: np.ndarray, at: np.ndarray, keys: pa.Array) -> None:
        if not len(q):
            return
        used, at = np.unique(at, return_inverse=True)
        self.keys.append(keys.take(pa.array(used)))
        self.rows.append((q, value, at + self.n_keys))
        self.held, self.n_keys = self.held + len(q), self.n_keys + len(used)
        if self.held > 3 * self.n * self.k:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """(query, value, place among the keys, keys): in order of query, value and key."""
        if not self.rows:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), pa.array([])
        q, value, at = (np.concatenate(x) for x in zip(*self.rows))
        keys = pa.concat_arrays(self.keys)
        by_key = pc.array_sort_indices(keys).to_numpy()
        place = np.empty(len(keys), np.int64)
        place[by_key] = np.arange(len(keys))
        by = np.lexsort((place[at], value, q))
        q, value, at = q[by], value[by], at[by]
        first = np.searchsorted(q, np.arange(self.n))
        keep = np.arange(len(q)) - first[q] < self.k
        q, value, at = q[keep], value[keep], at[keep]
        last = np.searchsorted(q, np.arange(self.n)) + self.k - 1
        full = (last < len(q)) & (np.r_[q, -1][np.minimum(last, len(q))] == np.arange(self.n))
        self.most[full] = value[last[full]]
        used, at = np.unique(at, return_inverse=True)
        keys = keys.take(pa.array(used))
        self.rows, self.keys, self.held, self.n_keys = [(q, value, at)], [keys], len(q), len(keys)
        return q, value, at, keys


def first_k(value: np.ndarray, k: int, usable: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k least usable values of each row, ties by column; rows and then values in order."""
    v = np.where(usable, value, np.inf)
    if v.shape[1] > k:
        usable = usable & (v <= np.partition(v, k - 1, axis=1)[:, k - 1 : k])
    row, col = np.nonzero(usable)
    by = np.lexsort((col, v[row, col], row))
    row, col = row[by], col[by]
    first = np.searchsorted(row, np.arange(len(v)))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], col[keep]
