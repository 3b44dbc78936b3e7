"""Vectorised kernels over the UTF-8 bytes of a batch of texts: words, word hashes, n-gram hashes.

Everything is numpy on whole batches. A word's hash is a sum of random values of its bytes at their places, an n-gram's
a tree of mixing steps, so that neither has an algebraic form that some texts could cancel out; they find candidates, and
callers that need certainty compare digests of the words themselves afterwards.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(20240229)
_PLACES = 64
#: A random value of each byte at each of the first places of a word.
_AT = _RNG.integers(0, 2**64, _PLACES * 256, dtype=np.uint64)
_TREE = U64(0x9E3779B97F4A7C15)
#: Bytes of words that are hashed at once.
_CHUNK = 1 << 22


def mix(h: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64 (public domain)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def binary_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array (nulls: empty), without copies where possible."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(off) and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - (off[0] if len(off) else 0)


def release() -> None:
    """Give memory that this worker no longer uses back, as workers live on between stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(Exception):
        ctypes.CDLL(None).malloc_trim(0)


def slices(off: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive runs of documents of about `most` bytes each; a longer document is a run of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of a run of documents: byte spans, document of each, position in its document."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, space: np.ndarray = IS_SPACE):
        self.buf, self.off = buf, off
        n = len(off) - 1
        word = ~space[buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[off] = True
        first, last = word.copy(), word.copy()
        if len(buf):
            first[1:] &= ~word[:-1] | edge[1:-1]
            last[:-1] &= ~word[1:] | edge[1:-1]
        self.at, self.to = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc_at = np.searchsorted(self.at, off).astype(np.int64)  # each document's first word
        self.count = np.diff(self.doc_at)
        self.doc = np.repeat(np.arange(n), self.count)
        self.pos = np.arange(len(self.at)) - np.repeat(self.doc_at[:-1], self.count)

    def hashes(self) -> np.ndarray:
        size = self.to - self.at
        out = np.empty(len(size), U64)
        for i, j in slices(np.concatenate([[0], np.cumsum(size)]), _CHUNK):
            n = size[i:j]
            first = np.cumsum(n) - n
            place = np.arange(int(n.sum())) - np.repeat(first, n)
            code = (place << 8) | self.buf[place + np.repeat(self.at[i:j], n)]
            value = _AT[np.minimum(code, len(_AT) - 1)]
            far = place >= _PLACES
            if far.any():
                value[far] = mix(code[far].astype(U64) * _TREE)
            out[i:j] = np.add.reduceat(value, first)
        return mix(out + size.astype(U64))

    def grams(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each run of n words that lies in one document."""
        fits = np.flatnonzero(self.pos + n <= np.repeat(self.count, self.count))
        run, out, done, width = hashes, None, 0, 1  # run: of `width` words, out: of `done`
        while True:
            if n & width:
                out = run if out is None else _join(out[: max(0, len(run) - done)], run[done:])
                done += width
            if 2 * width > n:
                return fits, out[fits]
            run = _join(run[: max(0, len(run) - width)], run[width:])
            width *= 2

    def line(self) -> tuple[bytes, np.ndarray]:
        """All words with one space after each, and where each begins there, with the end."""
        size = self.to - self.at + 1
        ends = np.concatenate([[0], np.cumsum(size)])
        out = np.full(int(ends[-1]), 32, np.uint8)
        for i, j in slices(ends, _CHUNK):
            n = size[i:j] - 1
            place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[place + np.repeat(ends[i:j], n)] = self.buf[place + np.repeat(self.at[i:j], n)]
        return out.tobytes(), ends


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a + _TREE) + b[: len(a)])


def planes(a: np.ndarray) -> bytes:
    """An integer array byte plane by byte plane: the shuffle's codec then finds the still upper planes."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def from_planes(b, n: int, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8, n * size).reshape(size, n).T).reshape(-1).view(dtype)
