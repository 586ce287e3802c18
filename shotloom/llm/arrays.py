"""Array work on Arrow batches of texts: words, word hashes, and sequence hashes.

A word is a run of bytes other than space and 0x09-0x0D; as no other UTF-8 byte has these values, words can be cut
from the bytes of a text directly.  Hashes are 64-bit and the same on every worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text that one step of array work holds at a time (a longer text is a step of its own).
STEP_BYTES = 1 << 20
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every input bit (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x + U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


_BYTES = mix(np.arange(256, dtype=U)) | U(1)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of about ``limit`` bytes; null texts have no bytes."""
    col = batch.column(column)
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and for every text the index of its first word (with the total at the end)."""
    if not len(data):
        return np.empty(0, U), np.zeros(len(offsets), np.int64)
    ink = ~SPACE[data]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begin = ink.copy()
    begin[1:] &= ~ink[:-1]
    begin[inner] = ink[inner]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.empty(0, U), np.zeros(len(offsets), np.int64)
    at = np.flatnonzero(ink)
    first = np.searchsorted(at, starts)
    length = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, length)
    weight = mix(np.arange(int(length.max()), dtype=U)) | U(1)
    with np.errstate(over="ignore"):
        h = np.add.reduceat((_LOWER if lower else _BYTES)[data[at]] * weight[place], first)
        return mix(h ^ mix(length.astype(U))), np.searchsorted(starts, offsets)


def windows(h: np.ndarray, size: int, salt: int) -> np.ndarray:
    """Hash of every ``size`` consecutive entries of ``h`` (of the whole array, so across texts as well)."""
    if len(h) < size:
        return np.empty(0, U)
    out = np.zeros(len(h) - size + 1, U)
    weight = mix(np.arange(size, dtype=U) + U(salt)) | U(1)
    if size <= 8:
        with np.errstate(over="ignore"):
            for k in range(size):
                out += h[k:len(h) - size + 1 + k] * weight[k]
        return mix(out)
    at = np.arange(len(out))
    return spans(h, at, at + size, salt)


def spans(h: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
    """Hash of the entries from ``start`` to ``end`` for any number of such spans.

    A polynomial in an odd base: differences of prefix sums, moved to the origin by the inverse of the base.
    """
    base = int(mix(np.array([salt], U))[0]) | 1
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(len(h) + 1, base, U))
        down = np.cumprod(np.full(len(h) + 1, pow(base, -1, 1 << 64), U))
        total = np.concatenate([np.zeros(1, U), np.cumsum(mix(h ^ U(salt)) * up[:-1])])
        return mix((total[end] - total[start]) * down[start] ^ mix((end - start).astype(U)))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
