"""Vectorised text kernels shared by the corpus operators: word segmentation, word hashes and n-gram hashes over the
UTF-8 bytes of a whole Arrow batch at once, so no operator loops over words in Python.

Defined results: a null text counts as an empty one; a word is a maximal run of ASCII letters, digits and non-ASCII
bytes of the lower-cased text; words never cross documents; an empty text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_B = 0x9E3779B97F4A7C15 | 1
_BINV = pow(_B, -1, 1 << 64)
_POW: list[np.ndarray] = []
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the splitmix64 one)."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * MIX2
    return x ^ (x >> np.uint64(31))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], dtype=np.uint64))[0])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        size = max(n, 1 << 20)
        up, down = np.full(size, _B, dtype=np.uint64), np.full(size, _BINV, dtype=np.uint64)
        up[0] = down[0] = 1
        _POW[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POW[0][:n], _POW[1][:n]


def pieces(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """The array in slices of about `most` bytes (a longer text is a slice of its own), each with its first row."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield at, texts.slice(at, to - at)
        at = to


def view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and the n + 1 offsets of the texts in them. Null counts as empty."""
    texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) else "")
    big = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if big else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n + 1 prefix sums; span_hash() turns two of them into the hash of the bytes between."""
    up, _ = _powers(len(data) + 1)
    p = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=p[1:])
    return p


def span_hash(p: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = _powers(len(p))
    return mix((p[ends] - p[starts]) * down[starts])


class Words:
    """The words of a slice of texts: doc (row of each word), start, end (bytes), hash; and p, the prefix sums."""

    def __init__(self, texts: pa.Array):
        data, off = view(pc.utf8_lower(pc.fill_null(texts, "")))
        self.n = len(off) - 1
        self.data, self.off = data, off
        w = _WORD[data]
        first = w.copy()
        first[1:] &= ~w[:-1]
        last = w.copy()
        last[:-1] &= ~w[1:]
        inner = off[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        first[inner] = w[inner]
        last[inner - 1] = w[inner - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(off, self.start, side="right") - 1
        self.p = prefix_hash(data)
        self.hash = span_hash(self.p, self.start, self.end)

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(indices of words of at least `size` bytes, the hash of their first `size` bytes)."""
        at = np.flatnonzero(self.end - self.start >= size)
        return at, span_hash(self.p, self.start[at], self.start[at] + size)


_K = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def shingles(words: Words, k: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, multiplicity) of the distinct k-word shingles of each text, by row and hash. A text of fewer than k
    words, but one at least, has one shingle of all its words; a text of no words has none."""
    h, doc = words.hash, words.doc
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = np.bincount(doc, minlength=words.n)
    at = np.arange(len(h))
    left = (np.cumsum(n)[doc]) - at
    whole = left >= k
    g = h * _K[0]
    for j in range(1, k):
        g[:-j] = g[:-j] + np.where(left[:-j] > j, h[j:] * _K[j], np.uint64(0))
    keep = whole | ((n[doc] < k) & (left == n[doc]))
    doc, g = doc[keep], mix(g[keep] + _K[4])
    order = np.lexsort((g, doc))
    doc, g = doc[order], g[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (g[1:] != g[:-1])
    at = np.flatnonzero(new)
    return doc[at], g[at], np.diff(np.append(at, len(g)))
