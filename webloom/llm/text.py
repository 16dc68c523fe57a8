"""Vectorised text kernels shared by the operators: Arrow strings to words, word hashes and shingles, a chunk of bytes at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that a kernel takes at once (one document at least): its arrays then stay near the CPU's caches.
CHUNK_BYTES = 1 << 20
_MULT = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, U64), np.ones(1, U64)]

_WORD = np.zeros(256, bool)
_WORD[np.r_[48:58, 65:91, 97:123, 128:256]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_MULT, pow(_MULT, -1, 1 << 64))):
            p = np.full(n, base, U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its n + 1 offsets from 0; nulls are empty texts."""
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offs, data = arr.buffers()
    if len(arr) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def lowered(arr: pa.Array) -> pa.Array:
    """Lower case, code point by code point, so that positions in characters stay."""
    return pc.utf8_lower(arr)


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents [a, b) of at most `most` bytes, or one longer document."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


@dataclass
class Words:
    """Words of some documents in order. starts, ends: bytes in data; first: of each document its first word, n + 1 in all; hashes: of the words."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Maximal runs of letters and digits (any character beyond ASCII but punctuation and symbols of Latin-1 and General Punctuation)."""
    n = len(data)
    w = _WORD[data]
    if n > 1:
        at = np.flatnonzero(data[:-1] == 0xC2)
        w[at] = w[at + 1] = False
        at = np.flatnonzero((data[:-1] == 0xE2) & (data[1:] == 0x80))
        for k in range(3):
            w[np.minimum(at + k, n - 1)] = False
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = w
    after = np.zeros(n + 1, bool)
    after[:n] = w
    cut = before & after & edge
    step = before != after
    starts = np.flatnonzero((step & after) | cut)
    ends = np.flatnonzero((step & before) | cut)
    first = np.searchsorted(starts, offsets)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[:n], out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * down[starts])
    return Words(data, offsets, starts, ends, first, hashes)


def word_chunks(arr: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, Words]]:
    """The words of an array's lower-cased texts, with the row that each chunk begins at."""
    data, off = buffers(lowered(arr))
    for a, b in chunks(off, most):
        yield a, words(data[off[a] : off[b]], off[a : b + 1] - off[a])


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n words in a row within a document and the word each begins at; a document of fewer words (one at least) has a single one of all its words."""
    total = len(w.hashes)
    counts = np.diff(w.first)
    doc_end = np.repeat(w.first[1:], counts)
    out = np.zeros(total, U64)
    for k in range(n):
        part = w.hashes[k:]
        if len(part) == 0:
            break
        ok = np.arange(k, total) < doc_end[: total - k]
        out[: total - k] += np.where(ok, mix64(part + U64(k * 0x632BE59BD9B4E019 & (2**64 - 1))), U64(0))
    at = np.arange(total)
    keep = (at + n <= doc_end) | ((np.repeat(counts, counts) < n) & (at == np.repeat(w.first[:-1], counts)))
    return mix64(out[keep]), at[keep]


def char_at(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Positions in characters for positions in UTF-8 bytes."""
    return np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[places]


def ragged(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array of a flat array cut at offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
