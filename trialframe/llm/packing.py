"""Best-fit packing of documents into token sequences (operator 6).

A document's ids are cut into pieces of at most ``capacity``.  How pieces share
sequences depends on their lengths alone, so the plan is made from the histogram
of lengths, which has at most ``capacity`` entries whatever the data:

1. large lengths are sorted into groups of equal cardinality (or less, where
   lengths lie far apart) and rounded up to the largest of their group;
2. the linear program over the configurations of these few sizes is solved by
   column generation, and rounded down;
3. actual lengths take the places of the rounded ones, which frees room;
4. what the rounding left over and the small lengths go, longest first, where
   they fit best.

Pieces then find their place by their rank among the pieces of equal length.
Ranks are counted within ``SALT`` parts of each length, so a common length is
split.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialframe.llm import arrowtext
from trialframe.session import durable

CAPACITY = 2048
END = 0
GROUPS = 128
#: Lengths up to this part of the capacity are small.
SMALL = 8
#: A group ends early before a length this part of the capacity below its largest.
SPREAD = 32
SALT = 64
ROUNDS = 600
#: Words kept by a task; all are dropped when more come.
_CACHE = 1_200_000

#: What the vocabulary file says of its splits; fixed values.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same splits for lower-case text of ASCII and Latin letters up to U+017F, for the faster engine.
_PLAIN_SPLIT = "[a-z\u00df-\u00f6\u00f8-\u017f]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\\sa-z0-9\u00df-\u00f6\u00f8-\u017f]+"
_ASCII = bytes([9, 10, 13, *range(32, 127)])
_NOT_PLAIN = "[^\u00c0-\u012f\u0131-\u017f]"
#: Characters whose white space or lower case other libraries may treat differently.
_ODD = "[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0\u0130\u03a3\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]"


@cache
def _unsettled() -> re.Pattern:
    """Characters that libraries may class differently.

    Settled are those below U+10000 that Unicode 3.2 assigned and that have kept
    their category to this day.
    """
    old, now = unicodedata.ucd_3_2_0.category, unicodedata.category
    settled = [c for c in range(0x80, 0xD800) if old(chr(c)) == now(chr(c)) != "Cn"]
    settled += [c for c in range(0xF900, 0xFFFE) if old(chr(c)) == now(chr(c)) != "Cn"]
    breaks = [k for k, c in enumerate(settled) if not k or c != settled[k - 1] + 1]
    runs = [(settled[i], settled[j - 1]) for i, j in zip(breaks, [*breaks[1:], len(settled)], strict=True)]
    return re.compile("[^\x00-\x7f" + "".join(f"\\u{i:04x}-\\u{j:04x}" for i, j in runs) + "]")


class WordIds:
    """Ids (little-endian 32-bit) of texts, as the tokenizer gives them; equal words are encoded once.

    Texts with special tokens, or characters whose class may differ between
    versions of Unicode, go to the library whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self.odd, self.not_plain = re.compile(_ODD), re.compile(_NOT_PLAIN)
        self.split, self.plain_split = regex.compile(_SPLIT), re.compile(_PLAIN_SPLIT)
        self.known: dict[str, bytes] = {}

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def words(self, text: str) -> list[str] | None:
        """The splits of a text; None if only the library is to be trusted with it."""
        if self.special.search(text):
            return None
        rest = text.encode().translate(None, _ASCII).decode()
        if not self.not_plain.search(rest):
            return self.plain_split.findall(text.lower())
        if self.odd.search(text) or _unsettled().search(rest):
            return None
        return self.split.findall(unicodedata.normalize("NFC", text).lower())

    def learn(self, words: list[str]) -> None:
        """Encode new words in one go, parted by spaces."""
        encoded = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids, word = np.array(encoded.ids, "<u4"), np.array(encoded.word_ids, np.int64)
        if len(words) and (len(word) == 0 or word[-1] != len(words) - 1 or (np.diff(word) > 1).any() or word[0]):
            self.known.update((w, self.library(w)) for w in words)
            return
        raw, at = ids.tobytes(), 4 * np.searchsorted(word, np.arange(len(words) + 1))
        self.known.update(zip(words, (raw[i:j] for i, j in zip(at[:-1], at[1:], strict=True)), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of some texts."""
        split = [self.words(x) for x in texts]
        distinct: set[str] = set()
        for words in split:
            distinct.update(words or ())
        if len(self.known) + len(distinct) > _CACHE:
            self.known.clear()
        new = [w for w in distinct if w not in self.known]
        if new:
            self.learn(new)
        ids = self.known.__getitem__
        return [self.library(x) if w is None else b"".join(map(ids, w)) for x, w in zip(texts, split, strict=True)]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, ids, salt``: each document's ids and ``end``, cut.

    A null text is empty.  ``salt`` spreads the rows of a task evenly.
    """
    mark = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, count = WordIds(path), 0
        for batch in batches:
            for block in arrowtext.blocks(batch.column(1)):
                raw = block.data.tobytes()
                texts = [raw[block.at[k] : block.at[k + 1]].decode() for k in range(len(block))]
                rows: list[tuple] = []
                for k, ids in enumerate(words.encode(texts)):
                    doc, ids = batch.column(0)[block.first + k].as_py(), ids + mark
                    for n, low in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[low : low + 4 * capacity]
                        rows.append((doc, n, low // 4, len(part) // 4, zlib.crc32(part), part, count % SALT))
                        count += 1
                doc, n, start, length, crc, part, salt = zip(*rows, strict=True)
                flat = pa.array(np.frombuffer(b"".join(part), "<u4").astype(np.int32))
                offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc, pa.int64()), pa.array(n, pa.int32()), pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array(salt, pa.int32()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "salt"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>, salt int"
    )


Run = tuple[int, tuple[int, ...]]


def _configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity."""
    best = np.zeros(capacity + 1)
    layers = []
    for _ in range(capacity // int(sizes.min())):
        options = np.full((len(sizes) + 1, capacity + 1), -1.0)
        options[0] = best
        for g, s in enumerate(sizes):
            options[g + 1, s:] = best[: capacity + 1 - s] + worth[g]
        choice = options.argmax(0)
        best = options[choice, np.arange(capacity + 1)]
        layers.append(choice)
    found, room = np.zeros(len(sizes)), capacity
    for choice in reversed(layers):
        g = choice[room]
        if g:
            found[g - 1] += 1
            room -= int(sizes[g - 1])
    return float(best[capacity]), found


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """Configurations and how often to use each: the linear program's basis, rounded down."""
    n = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(ROUNDS):
        worth = np.linalg.solve(basis.T, np.ones(n))
        value, column = _configuration(sizes, np.maximum(worth, 0), capacity)
        if value <= 1 + 1e-7:
            break
        step, amount = np.linalg.solve(basis, column), np.linalg.solve(basis, demand)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, np.maximum(amount, 0) / step, np.inf)
        basis[:, int(ratio.argmin())] = column
    amount = np.linalg.solve(basis, demand)
    return [(int(x + 1e-6), basis[:, k]) for k, x in enumerate(amount) if x >= 1 - 1e-6]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[Run]:
    """Sequences as runs ``(how many, lengths in each)`` that hold exactly the histogram."""
    runs: list[Run] = []
    left = {k: n for k, n in histogram.items() if n}
    if capacity in left:
        runs.append((left.pop(capacity), (capacity,)))
    large = sorted((k for k in left if k > capacity // SMALL), reverse=True)
    open_runs: dict[int, list[Run]] = defaultdict(list)
    if large:
        share = -(-sum(left[k] for k in large) // groups)
        queues: dict[int, list[list[int]]] = {}
        room, size = 0, 0
        for length in large:
            count = left.pop(length)
            while count:
                if not room or size - length > capacity // SPREAD:
                    room, size = share, length
                take = min(count, room)
                queues.setdefault(size, []).append([length, take])
                room, count = room - take, count - take
        sizes = np.array(list(queues))
        demand = np.array([sum(n for _, n in q) for q in queues.values()], float)
        for times, column in configurations(sizes, demand, capacity):
            slots = [int(s) for s, a in zip(sizes, column, strict=True) for _ in range(round(a))]
            while times and slots:
                # As many equal sequences as the heads of the queues allow.
                heads = [(s, queues[s][0]) for s in slots if queues[s]]
                need = defaultdict(int)
                for s, _ in heads:
                    need[s] += 1
                if not heads:
                    break
                many = min([times] + [queues[s][0][1] // k or 1 for s, k in need.items()])
                lengths = []
                for s in slots:
                    if not queues[s]:
                        continue
                    # With fewer than one round of equal heads, the next head follows.
                    head = queues[s][0]
                    if head[1] < many:
                        continue
                    head[1] -= many
                    lengths.append(head[0])
                    if not head[1]:
                        queues[s].pop(0)
                open_runs[capacity - sum(lengths)].append((many, tuple(lengths)))
                times -= many
        for queue in queues.values():
            for length, count in queue:
                left[length] = left.get(length, 0) + count
    for length in sorted(left, reverse=True):
        count = left[length]
        while count:
            room = min((r for r, have in open_runs.items() if have and r >= length), default=None)
            if room is None:
                each = capacity // length
                if count >= each:
                    open_runs[capacity - each * length].append((count // each, (length,) * each))
                if count % each:
                    open_runs[capacity - count % each * length].append((1, (length,) * (count % each)))
                break
            many, lengths = open_runs[room].pop()
            take = min(many, count)
            if many > take:
                open_runs[room].append((many - take, lengths))
            open_runs[room - length].append((take, (*lengths, length)))
            count -= take
    return runs + [run for have in open_runs.values() for run in have]


def _slots(runs: list[Run]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For ranges of ranks of a length: key ``length << 40 | first rank``, first sequence, offset."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for many, lengths in runs:
        offset = 0
        for length in lengths:
            rows.append(((length << 40) | used[length], sequence, offset))
            used[length] += many
            offset += length
        sequence += many
    rows.sort()
    key, first, offset = np.array(rows, np.int64).reshape(-1, 3).T
    return key, first, offset, sequence


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``), one row per piece.

    ``docs`` has ``doc_id`` and ``text``; other columns are not read.  Every
    row gives at least one piece, also with a null or empty text (its piece
    holds ``end`` alone) or a null id; repeated rows are packed each on its
    own.  No rows give no rows.  The histogram of lengths and its parts, at
    most ``capacity * SALT`` numbers, pass through the driver.
    """
    cut = pieces(docs, path, capacity, end)
    cut = durable(cut if with_ids else cut.drop("ids"))
    counts = cut.groupBy("length", "salt").count().toArrow()
    length, salt, count = (counts.column(k).to_numpy() for k in range(3))
    before = np.zeros((capacity + 1, SALT), np.int64)
    before[length, salt] = count
    histogram = {int(k): int(n) for k, n in enumerate(before.sum(1)) if n}
    before = np.cumsum(before, axis=1) - before
    key, first, at, _ = _slots(plan(histogram, capacity))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((before, key, first, at))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, key, first, at = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = before[length, batch.column("salt").to_numpy()] + batch.column("rank").to_numpy() - 1
            own = (length << 40) | rank
            slot = np.searchsorted(key, own, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns] + [pa.array(first[slot] + own - key[slot]), pa.array(at[slot])],
                names=[*columns, "sequence_id", "offset"],
            )

    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long, "
    return cut.withColumn("rank", F.row_number().over(order)).mapInArrow(
        place, fields + ("ids array<int>, " if with_ids else "") + "sequence_id long, offset long"
    )
