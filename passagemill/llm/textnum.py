"""Column-at-a-time text kernels shared by the operators of this subpackage.

Texts arrive as Arrow string arrays; everything below works on their UTF-8 bytes
with NumPy, so no Python string is made per document or per word.  Slices are cut
by bytes, never inside a document, so that temporaries stay small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: 1 where a byte belongs to a word: ASCII letters, digits, underscore and all of UTF-8's multi-byte range.
WORD = np.zeros(256, np.bool_)
WORD[128:] = True
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_":
    WORD[_c] = True
#: 1 where a byte is not ASCII white space.
INK = np.ones(256, np.bool_)
INK[[9, 10, 11, 12, 13, 32]] = False


def column(batch: pa.RecordBatch, name: str, lower: bool = False) -> pa.Array:
    """The named text column as a plain string array; null reads as an empty text."""
    a = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_string(a.type):
        a = a.cast(pa.string())
    if a.null_count:
        a = pc.fill_null(a, "")
    return pc.utf8_lower(a) if lower else a


def raw(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (one more than rows) of a string array, without a copy."""
    if len(a) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = a.buffers()
    o = np.frombuffer(off, np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


def slices(a: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of whole rows of about limit bytes."""
    buf, off = raw(a)
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, len(a))
        yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def tokens(buf: np.ndarray, off: np.ndarray, table: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each token and its row; tokens never cross a row's edge."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    ink = table[buf]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    first[inner] = ink[inner]
    last[inner - 1] = ink[inner - 1]
    s = np.flatnonzero(first)
    e = np.flatnonzero(last) + 1
    return s, e, np.searchsorted(off, s, "right") - 1


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for n places or more; the longest pair made so far is kept."""
    if not _powers or len(_powers[0][0]) <= n:
        size = 1 << max(20, int(n).bit_length())
        p = np.full(size + 1, _BASE, np.uint64)
        q = np.full(size + 1, pow(_BASE, -1, 1 << 64), np.uint64)
        p[0] = q[0] = 1
        _powers[0] = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return _powers[0]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: equal inputs give equal outputs, and all output bits depend on all input bits."""
    h = h ^ np.uint64(seed * 0xD6E8FEB86659FD93 & _MASK)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span values[start:end] from one prefix sum (a polynomial modulo 2**64)."""
    p, q = _power(len(values) + 1)
    acc = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * p[: len(values)], out=acc[1:])
    return mix((acc[end] - acc[start]) * q[start] + (end - start).astype(np.uint64))


def word_hash(text: str | bytes) -> int:
    """The hash that span_hash gives a span with these bytes."""
    b = np.frombuffer(text.encode() if isinstance(text, str) else text, np.uint8)
    return int(span_hash(b, np.array([0]), np.array([len(b)]))[0])


def window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w successive values, in time independent of w (prefix and suffix minima by blocks)."""
    n = len(h)
    if n < w:
        return np.zeros(0, h.dtype)
    pad = -n % w
    top = np.iinfo(h.dtype).max
    b = np.concatenate([h, np.full(pad, top, h.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(b, axis=1).ravel()
    right = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])
