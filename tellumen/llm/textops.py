"""Vectorised text kernels over Arrow string buffers: no Python object is made per word.

Words are the maximal runs of bytes other than space, tab, LF, VT, FF and CR (0x20, 0x09-0x0D); A-Z are
lower-cased. A word's hash is a 64-bit multilinear hash of its bytes, finished with a splitmix step; it does
not depend on the process, machine or Python version.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything in ASCII but letters and digits, for words without their punctuation.
PUNCTUATED = np.zeros(256, bool)
PUNCTUATED[:128] = [not chr(c).isalnum() for c in range(128)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P1, _P2, _P3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = np.asarray(x, U)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * _P2
        x = (x ^ (x >> U(27))) * _P3
    return x ^ (x >> U(31))


def coefficients(n: int, salt: int = 0) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U) + U(salt << 32)) * _P1) | U(1)


_COEF = [coefficients(64)]


def _coef(n: int) -> np.ndarray:
    if n > len(_COEF[0]):
        _COEF[0] = coefficients(max(n, 2 * len(_COEF[0])))
    return _COEF[0]


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its n + 1 offsets; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.fill_null("") if arr.null_count else arr
    n = len(arr)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], kind)[arr.offset : arr.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


class Words:
    """The words of a string array, in order: `hash`, `doc` (row), `start`, `end` (byte offsets in `data`)."""

    def __init__(self, arr: pa.Array, lower: bool = True, sep: np.ndarray = _SEP):
        self.data, self.off = buffers(arr)
        self.n_docs = len(self.off) - 1
        data = _LOWER[self.data] if lower else self.data
        self.low = data
        n = len(data)
        if not n:
            self.start = self.end = np.zeros(0, np.int64)
            self.doc, self.hash = np.zeros(0, np.int64), np.zeros(0, U)
            self.first = np.zeros(self.n_docs + 1, np.int64)
            return
        word = ~sep[data]
        edge = np.zeros(n + 1, bool)
        edge[self.off] = True
        opens = word.copy()
        opens[1:] &= ~word[:-1] | edge[1:n]
        closes = word.copy()
        closes[:-1] &= ~word[1:] | edge[1:n]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, self.off)
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))
        self.hash = span_hash(data, word, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)


def span_hash(data: np.ndarray, inside: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans data[start:end]; inside marks the bytes of all spans, which do not overlap."""
    if not len(start):
        return np.zeros(0, U)
    size = end - start
    at = np.cumsum(size) - size
    pos = np.arange(int(size.sum())) - np.repeat(at, size)
    with np.errstate(over="ignore"):
        prod = (data[inside].astype(U) + U(1)) * _coef(int(size.max()))[pos]
        return mix(np.add.reduceat(prod, at) + size.astype(U) * _P1)


def fold(acc: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """An order-sensitive combination of two hashes."""
    with np.errstate(over="ignore"):
        return mix(acc * _P1 + nxt)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each row, in order, and where each row's begin (n_docs + 1). A row of
    fewer words has its whole sequence as one shingle; a row without words has none."""
    count = np.diff(w.first)
    out_n = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(out_n)])
    if not len(w):
        return np.zeros(0, U), begin
    pos = np.arange(begin[-1]) - np.repeat(begin[:-1], out_n) + np.repeat(w.first[:-1], out_n)
    size = np.repeat(np.minimum(count, n), out_n)
    acc = fold(size.astype(U), w.hash[pos])
    for k in range(1, n):
        go = size > k
        if go.all():
            acc = fold(acc, w.hash[pos + k])
        else:
            acc[go] = fold(acc[go], w.hash[pos[go] + k])
    return acc, begin


class HashIndex:
    """Finds 64-bit hashes in a bounded sorted table by their top bits: a few vectorised probes, no objects."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.asarray(keys, U)
        self.bits = max(1, int(len(self.keys)).bit_length() + 1)
        self.at = np.searchsorted(self.keys, np.arange(1 << self.bits, dtype=U) << U(64 - self.bits))
        self.padded = np.concatenate([self.keys, np.full(1, 2**64 - 1, U)])
        widest = int(np.diff(np.append(self.at, len(self.keys))).max()) if len(self.keys) else 0
        self.probes = widest

    def find(self, h: np.ndarray) -> np.ndarray:
        """Positions in keys, or -1."""
        pos = self.at[(h >> U(64 - self.bits)).astype(np.int64)]
        todo = np.flatnonzero(self.padded[pos] < h)
        for _ in range(self.probes):
            if not len(todo):
                break
            pos[todo] += 1
            todo = todo[self.padded[pos[todo]] < h[todo]]
        hit = (self.padded[pos] == h) & (pos < len(self.keys))
        return np.where(hit, pos, -1)


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as Spark's long, bit for bit."""
    return np.ascontiguousarray(x, U).view(np.int64)
