"""Readers of public tokenizer files, and a bounded cache of encoded pieces of text."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def default_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@functools.cache
def library(path: str):
    """The tokenizer of a .json file, without truncation and padding."""
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


_RESIDENT: dict = {}


def resident(key, make: Callable):
    """What a worker keeps between tasks: one thing at a time.

    A worker serves one stage after another; tables and caches of an earlier one would stay beside those of the next.
    """
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def make_room() -> None:
    """Let go of what earlier stages left in this worker, before work that needs memory of its own."""
    _RESIDENT.clear()
    pa.default_memory_pool().release_unused()


class PieceCache:
    """piece -> value with two generations: a full young one becomes the old one, whose entries move up again on use.

    Bounded by ``size`` entries per generation, by ``most`` bytes in both together if given (pieces, values and what Python
    adds to them), and by leaving out pieces over 64 bytes.
    """

    ENTRY = 200     # bytes of a dict entry and two objects beside their content

    def __init__(self, encode: Callable[[list[bytes]], list], size: int = 400_000, most: int | None = None):
        self.encode, self.size, self.most = encode, size, most
        self.young: dict = {}
        self.old: dict = {}
        self.held = 0

    def values(self, pieces: list[bytes]) -> list:
        """The values of distinct pieces, in their order."""
        young, old = self.young, self.old
        out = [young.get(p) for p in pieces]
        missing = []
        for k, v in enumerate(out):
            if v is None:
                v = old.get(pieces[k])
                if v is None:
                    missing.append(k)
                else:
                    out[k] = young[pieces[k]] = v
        if missing:
            for k, v in zip(missing, self.encode([pieces[k] for k in missing])):
                out[k] = v
                if len(pieces[k]) <= 64:
                    young[pieces[k]] = v
                    self.held += len(pieces[k]) + (len(v) if self.most else 0)
        if len(young) > self.size or (self.most and self.held + self.ENTRY * len(young) > self.most // 2):
            self.old, self.young, self.held = young, {}, 0
        return out


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 4 << 20):
    """(first row, texts) of about ``limit`` bytes each, as large-string arrays; nulls become empty texts."""
    col = batch.column(column).cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, col.slice(i, j - i)
        i = j


def gather(lists: pa.Array, values: Callable[[list[bytes]], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Replace every piece of lists of pieces by its ids: all ids, and for every list where its ids begin (with the end)."""
    kinds = lists.flatten().cast(pa.large_binary()).dictionary_encode()
    got = values(kinds.dictionary.to_pylist())
    size = np.fromiter((len(v) >> 2 for v in got), np.int64, len(got))
    flat, start = np.frombuffer(b"".join(got), "<u4"), np.cumsum(size) - size
    at = kinds.indices.to_numpy()
    n = size[at]
    ends = np.append(0, np.cumsum(n))
    ids = flat[np.repeat(start[at] - ends[:-1], n) + np.arange(int(ends[-1]))]
    lengths = pc.list_value_length(lists).to_numpy()
    return ids, ends[np.append(0, np.cumsum(lengths))]
