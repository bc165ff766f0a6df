"""Vectorised work on the text column of Arrow batches inside Spark tasks.

A batch is cut into blocks of whole texts of about ``BLOCK_BYTES`` (a longer
text is a block of its own), so that memory stays a small multiple of the
largest text.  Hashes are 64-bit and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_PRIME), -1, 1 << 64))
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACES = np.random.default_rng(77).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Block:
    """Some whole texts as one run of bytes; text i is ``data[at[i]:at[i + 1]]``."""

    def __init__(self, first: int, data: np.ndarray, at: np.ndarray) -> None:
        self.first, self.data, self.at = first, data, at

    def __len__(self) -> int:
        return len(self.at) - 1


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of a string or binary column in order; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return
    _, offsets, values = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values, dtype=np.uint8) if values else np.zeros(0, np.uint8)
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield Block(i, data[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


class Words:
    """Runs of bytes other than space and 0x09-0x0D: place, text and hash of each."""

    def __init__(self, block: Block) -> None:
        solid = ~_SPACE[block.data]
        n = len(solid)
        head = np.zeros(n + 1, dtype=bool)
        head[block.at] = True
        before = np.empty(n, dtype=bool)
        before[:1] = False
        before[1:] = solid[:-1]
        after = np.empty(n, dtype=bool)
        after[-1:] = False
        after[:-1] = solid[1:]
        self.start = np.flatnonzero(solid & (~before | head[:n]))
        self.end = np.flatnonzero(solid & (~after | head[1:])) + 1
        self.text = np.searchsorted(block.at, self.start, side="right") - 1
        self.hash = mix(span_hash(block.data, self.start, self.end))
        #: Text i has the words ``span[i]`` to ``span[i + 1]``.
        self.span = np.searchsorted(self.text, np.arange(len(block) + 1))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of each non-empty ``data[start:end]``, wherever it lies."""
    n = len(data)
    if not len(start):
        return np.zeros(0, np.uint64)
    power = np.full(n, _PRIME)
    power[:1] = 1
    power = np.multiply.accumulate(power)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * power, out=total[1:])
    back = np.full(n, _INVERSE)
    back[:1] = 1
    back = np.multiply.accumulate(back)
    return (total[end] - total[start]) * back[start]


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words, and the text of each.

    A text of fewer words has one window, of all its words; a text without
    words has none.  Repeated windows stay.
    """
    n = len(words.hash)
    count = np.diff(words.span)
    total = np.zeros(max(n - size + 1, 0), np.uint64)
    for k in range(size):
        total += words.hash[k : k + len(total)] * _PLACES[k]
    inside = words.text[: len(total)] == words.text[size - 1 :][: len(total)]
    hashes, text = total[inside], words.text[: len(total)][inside]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            there = count[short] > k
            extra[there] += words.hash[words.span[short[there]] + k] * _PLACES[k]
        hashes, text = np.concatenate([hashes, extra]), np.concatenate([text, short])
        order = np.argsort(text, kind="stable")
        hashes, text = hashes[order], text[order]
    return mix(hashes), text


def per_text(ufunc: np.ufunc, values: np.ndarray, text: np.ndarray, n: int, empty: int) -> np.ndarray:
    """``ufunc`` over the values of each of ``n`` texts; ``text`` ascends."""
    out = np.full(n, empty, values.dtype)
    if len(values):
        there, at = np.unique(text, return_index=True)
        out[there] = ufunc.reduceat(values, at)
    return out


def int_lists(values: np.ndarray) -> pa.Array:
    """A two-dimensional array as a list<int64> column."""
    rows, width = values.shape
    flat = pa.array(np.ascontiguousarray(values).reshape(-1).view(np.int64))
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), flat)
