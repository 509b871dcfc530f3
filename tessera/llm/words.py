"""Vectorised words and rolling word-n-gram hashes over blocks of UTF-8 texts."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U64 = np.uint64
_MASK = (1 << 64) - 1


def _separators(ranges: list[tuple[int, int]]) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


#: Bytes that belong to words: all but ASCII white space; letters, digits and everything beyond ASCII.
NOT_SPACE = _separators([(0x20, 0x20), (0x09, 0x0D)])
ALPHANUMERIC = _separators([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_OUTLINE = np.arange(256, dtype=np.uint8)
_OUTLINE[65:91] = 65
_OUTLINE[97:123] = 97
_OUTLINE[128:] = 97
_OUTLINE[48:58] = 57
_BYTE = np.random.default_rng(20_240_601).integers(0, 1 << 63, size=256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public splitmix64 constants); every output bit depends on every input bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@lru_cache(maxsize=2)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, U64(base), dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _power_table(base: int, size: int) -> np.ndarray:
    return _powers(base, 1 << max(16, (size - 1).bit_length()))[:size]


def span_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from one prefix sum over the whole block."""
    size = len(raw)
    prefix = np.zeros(size + 1, dtype=U64)
    np.cumsum(_BYTE[raw] * _power_table(_BASE, size), out=prefix[1:])
    own = (prefix[ends] - prefix[starts]) * _power_table(_INVERSE, size)[starts]
    return mix(own ^ ((ends - starts).astype(U64) << U64(48)))


class Words:
    """The words of a block of texts: where they are, whose they are, and a 64-bit hash of each."""

    def __init__(self, texts: list[bytes], word_bytes: np.ndarray, lower: bool) -> None:
        joined = b" ".join(texts) + b" "
        raw = np.frombuffer(joined, dtype=np.uint8)
        self.bytes = _LOWER[raw] if lower else raw
        self.buffer = self.bytes.tobytes() if lower else joined
        inside = np.zeros(len(raw) + 1, dtype=np.int8)
        inside[1:] = word_bytes[self.bytes]
        edges = np.diff(inside)
        self.starts = np.flatnonzero(edges == 1)
        self.ends = np.flatnonzero(edges == -1)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.offsets = np.concatenate(([0], np.cumsum(lengths + 1)))
        #: ``first[d]`` to ``first[d + 1]`` are the words of text ``d``.
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int64), self.counts)
        self._hash: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = span_hash(self.bytes, self.starts, self.ends)
        return self._hash

    @property
    def shape(self) -> np.ndarray:
        """A hash of each word's outline: capitals, small letters and digits as one sign each, runs as one."""
        outline = _OUTLINE[self.bytes]
        keep = np.ones(len(outline), dtype=bool)
        keep[1:] = outline[1:] != outline[:-1]
        at = np.concatenate(([0], np.cumsum(keep)))
        return span_hash(outline[keep], at[self.starts], at[self.ends])

    def rolling(self, n: int, seed: int = 1) -> np.ndarray:
        """Hash of the n words from each place; where :meth:`valid` is false it crosses a text's end."""
        h, size = self.hash, len(self)
        out = np.zeros(size, dtype=U64)
        if size < n:
            return out
        factor = U64((seed * 0xD1342543DE82EF95 | 1) & _MASK)
        own = mix(h + U64(seed & _MASK)) if seed != 1 else h
        acc = own[: size - n + 1].copy()
        for k in range(1, n):
            acc *= factor
            acc += own[k : size - n + 1 + k]
        out[: size - n + 1] = mix(acc)
        return out

    def valid(self, n: int) -> np.ndarray:
        """Whether n consecutive words of one text start here."""
        return np.arange(len(self)) + n <= np.repeat(self.first[1:], self.counts)

    def place(self) -> np.ndarray:
        """The index of each word in its own text."""
        return np.arange(len(self)) - np.repeat(self.first[:-1], self.counts)

    def word(self, k: int) -> bytes:
        return self.buffer[self.starts[k] : self.ends[k]]
