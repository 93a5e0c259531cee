"""Whole batches of texts as one byte array: words, fingerprints and digests computed with numpy, many documents at once.

A batch is (data, offsets): the UTF-8 bytes of all texts one after the other and the n + 1 borders between
them. Nothing here crosses a border.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
U = np.uint64


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


INVERSE = U(_inverse(int(BASE)))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n; kept for the next batch."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        one = np.ones(1, U)
        _powers[size] = tuple(np.concatenate([one, np.cumprod(np.full(size - 1, b, U))]) for b in (BASE, INVERSE))
    up, down = _powers[size]
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def batch_of(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and borders of an Arrow string column; NULL counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64, len(texts) + 1, texts.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int):
    """Runs [a, b) of consecutive documents of at most `most` bytes together, or one longer document."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


def byte_table(outside: str) -> np.ndarray:
    """True for bytes that belong to words; `outside` lists those that do not."""
    table = np.ones(256, bool)
    table[np.frombuffer(outside.encode("latin-1"), np.uint8)] = False
    return table


SPACED = byte_table(" \t\n\x0b\x0c\r")
LETTERS_AND_DIGITS = byte_table("".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])))


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte ranges of all words, and for each document the number of words before it (n + 1 values)."""
    inside = table[data]
    full = offsets[:-1] < offsets[1:]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    at, last = offsets[:-1][full], offsets[1:][full] - 1
    starts[at], ends[last] = inside[at], inside[last]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def fingerprints(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit polynomial fingerprint of each byte range."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1 + 1000 * seed)) * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start] ^ (end - start).astype(U) << U(56))


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp: the fingerprint of values[i : i + width] for every i, in time independent of the width."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, U)
    np.cumsum((values + U(1)) * up[:-1], out=total[1:])
    return mix((total[width:] - total[:n]) * down[:n])


def window_starts(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a window of `width` items fits into its document, and the number of them before each document."""
    many = np.maximum(np.diff(first) - width + 1, 0)
    before = np.concatenate([[0], np.cumsum(many)])
    return np.arange(before[-1]) + np.repeat(first[:-1] - before[:-1], many), before


def covered(hit: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n items lie in a window of `width` that starts at a position in `hit`."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, hit, 1)
    np.add.at(edge, np.minimum(hit + width, n), -1)
    return np.cumsum(edge[:-1]) > 0
