"""Byte-level BPE by tree reduction (operator 2).

Encoding maps text to a monoid: the encodings of two halves are joined by
encoding anew a window around their boundary.  A token sequence is the encoding
of its bytes exactly if each pair of neighbours is the encoding of its own
bytes, so the window need only grow until its outer tokens agree with their
neighbours: no token beyond can change.  Decoding concatenates up the tree.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.llm import arrowtext

_PIECES = 300_000
_HALVES = 300_000
_PAIRS = 1_000_000
_MEMO_BYTES = 12
_LEAF = 64


class ByteBpe(dict):
    """Encoder and decoder for a rank file; as a dict, piece of text → its ids (32-bit)."""

    def __init__(self, path: str, pattern: str) -> None:
        super().__init__()
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.rank = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.part = {rank: token for token, rank in self.rank.items()}
        self.split = regex.compile(pattern)
        self.halves: dict[bytes, tuple[int, ...]] = {}
        self.agrees: dict[tuple[int, int], bool] = {}

    def merge(self, data: bytes) -> tuple[int, ...]:
        """The encoding of a few bytes: merge the neighbours of lowest rank, leftmost first."""
        parts = [data[k : k + 1] for k in range(len(data))]
        rank = self.rank
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = rank.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(rank[x] for x in parts)

    def neighbours(self, a: int, b: int) -> bool:
        """Whether two tokens side by side encode their own bytes."""
        key = (a, b)
        known = self.agrees.get(key)
        if known is None:
            if len(self.agrees) >= _PAIRS:
                self.agrees.clear()
            known = self.agrees[key] = self.merge(self.part[a] + self.part[b]) == key
        return known

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of two encoded neighbours together."""
        if not left or not right or self.neighbours(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            window = self.merge(b"".join(self.part[t] for t in left[-i:] + right[:j]))
            before = i == len(left) or self.neighbours(left[-i - 1], window[0])
            after = j == len(right) or self.neighbours(window[-1], right[j])
            if before and after:
                return left[: len(left) - i] + window + right[j:]
            i = i if before else min(len(left), 2 * i)
            j = j if after else min(len(right), 2 * j)

    def tree(self, data: bytes) -> tuple[int, ...]:
        """The encoding of bytes by halves."""
        if len(data) <= 1:
            return (self.rank[data],) if data else ()
        known = self.halves.get(data)
        if known is None:
            middle = len(data) // 2
            known = self.join(self.tree(data[:middle]), self.tree(data[middle:]))
            if len(data) <= _MEMO_BYTES:
                if len(self.halves) >= _HALVES:
                    self.halves.clear()
                self.halves[data] = known
        return known

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.rank.get(data)
        ids = np.array(self.tree(data) if whole is None else (whole,), np.int32).tobytes()
        if len(piece) <= 64:
            if len(self) >= _PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text: each match of the pattern on its own, without special tokens."""
        return np.frombuffer(b"".join(map(self.__getitem__, self.split.findall(text))), np.int32)

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids, concatenated up the tree."""
        if len(ids) <= _LEAF:
            return b"".join(map(self.part.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids array<int>`` for every row of ``docs`` (``doc_id``, ``text``).

    A null or empty text has no ids.  Ids and rows may repeat or be null; other
    columns are not read.  ``path`` is a rank file that executors can open.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(path, pattern)
        for batch in batches:
            for block in arrowtext.blocks(batch.column(1)):
                raw = block.data.tobytes()
                ids = [bpe.encode(raw[block.at[k] : block.at[k + 1]].decode()) for k in range(len(block))]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, len(block)), lists], names=["doc_id", "ids"]
                )

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` (``doc_id``, ``ids``) with the ids' bytes as ``decoded``; null ids have none."""
    schema = f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(path, pattern)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                found = [bpe.decode(ids) for ids in (x.as_py() or [] if x.values is None else x.values.to_numpy().tolist() for x in part.column(1))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(found, pa.binary())], names=["doc_id", "ids", "decoded"]
                )

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: digests of the ids and of their bytes."""
    return decode(encode(docs, path, pattern), path, pattern).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
