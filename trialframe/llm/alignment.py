"""Alignment of two tokenizers over the bytes they share (operator 13).

Tokens of both are rows of 0/1 matrices over the bytes of a text, held as
compressed sparse rows.  The row-by-row (Gustavson) product of one with the
other's transpose links tokens that overlap, weighted by their common bytes.
Offsets where tokens of both end cut the text into groups; the product of the
token-group matrices links tokens of one group.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.llm import arrowtext
from trialframe.session import durable

#: Pairs of ids whose counts are broadcast (16 bytes each); those of the others are joined.
HOT_PAIRS = 1 << 18
#: Products are made in slices of about so many terms.
TERMS = 1 << 21
_B_BITS = 32
#: Units (words with what follows up to the next cut) whose ids a task keeps; all go when more come.
_UNITS = 400_000
_LONGEST = 48
#: Units encoded as one text.
_CHUNK = 256
#: A blank after something solid.  White space by any library's account is not solid.
_CUT = re.compile("(?<![\\s\u180e\u200b\u2060\ufeff]) ")
_BLANK = "\u2581"


class Csr:
    """A sparse matrix of ones: the columns of row i are ``columns[at[i]:at[i + 1]]``."""

    def __init__(self, at: np.ndarray, columns: np.ndarray, width: int) -> None:
        self.at, self.columns, self.width = at, columns, width

    @classmethod
    def spans(cls, lengths: np.ndarray) -> Csr:
        """Rows that cover consecutive runs of columns."""
        at = np.concatenate([[0], np.cumsum(lengths)])
        return cls(at, np.arange(at[-1]), int(at[-1]))

    def transposed(self) -> Csr:
        rows = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))
        order = np.argsort(self.columns, kind="stable")
        at = np.searchsorted(self.columns[order], np.arange(self.width + 1))
        return Csr(at, rows[order], len(self.at) - 1)

    def product(self, other: Csr) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(row, column, value)`` of the product, some rows at a time.

        Each entry of a row selects a row of ``other``; what they hold is
        added up.  A slice has about ``TERMS`` terms, or one row's.
        """
        each = np.diff(other.at)[self.columns]
        terms = np.concatenate([[0], np.cumsum(each)])[self.at]
        low, rows = 0, len(self.at) - 1
        while low < rows:
            high = max(low + 1, int(np.searchsorted(terms, terms[low] + TERMS, side="right")) - 1)
            mine = slice(self.at[low], self.at[high])
            n = each[mine]
            row = np.repeat(np.repeat(np.arange(low, high), np.diff(self.at[low : high + 1])), n)
            start = np.repeat(other.at[self.columns[mine]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            column = other.columns[start + np.arange(len(row))]
            key = row * other.width + column
            if (key[1:] < key[:-1]).any():
                key.sort()
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key
            value = np.diff(np.concatenate([first, [len(key)]]))
            yield key[first] // max(other.width, 1), key[first] % max(other.width, 1), value
            low = high


class Tokenizers:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = [x for x in range(256) if x not in set(plain)]
        byte = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(moved)}
        size = self.a.get_vocab_size()
        entries = [self.a.id_to_token(k) for k in range(size)]
        self.a_bytes = [bytes(byte[c] for c in x) if set(x) <= byte.keys() else x.encode() for x in entries]
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(x[3:5], 16)]) if self.b.is_byte(k) else x.replace("▁", " ").encode()
            for k, x in enumerate(pieces)
        ]
        self.a_length = np.array([len(x) for x in self.a_bytes])
        self.b_length = np.array([len(x) for x in self.b_bytes])
        # Decimal ids with what stands before them: nothing, a new group, the same side, the other side.
        digits = [str(k).encode() for k in range(max(size, len(pieces)))]
        marked = [mark + x for mark in (b"", b";", b",", b"|") for x in digits]
        self.written, self.ids = np.array(marked, dtype=object), len(digits)
        # Without pieces that go on after a blank, and without rewriting, no token of b reaches over a cut.
        free = not any(_BLANK in x.lstrip(_BLANK) for x in pieces)
        self.cuts = free and self.b.normalize("\ufb01  \u2460 e\u0301") == f"{_BLANK}\ufb01{_BLANK * 2}\u2460{_BLANK}e\u0301"
        #: Ids (32-bit) by both of a unit after a space, and the units that do not come back.
        self.unit_a: dict[str, bytes] = {}
        self.unit_b: dict[str, bytes] = {}
        self.bad = {""}

    def whole(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids by both of every text after a space; None unless they join to its bytes."""
        a = [x.ids for x in self.a.encode_batch_fast([" " + x for x in texts], add_special_tokens=False)]
        out: list[tuple[np.ndarray, np.ndarray] | None] = []
        for text, left, right in zip(texts, a, self.b.encode(texts, num_threads=1), strict=True):
            data = (" " + text).encode()
            same = b"".join(map(self.a_bytes.__getitem__, left)) == data == b"".join(map(self.b_bytes.__getitem__, right))
            out.append((np.array(left, "<i4"), np.array(right, "<i4")) if same and text else None)
        return out

    def _keep(self, unit: str, ids: tuple[np.ndarray, np.ndarray] | None) -> None:
        if ids is None:
            self.bad.add(unit)
        self.unit_a[unit], self.unit_b[unit] = (x.tobytes() for x in ids) if ids else (b"", b"")

    def learn(self, units: list[str]) -> None:
        """Encode new units, many in one text; those of a text that does not come back, one by one."""
        solid = [u for u in units if _CUT.search(u + " ", max(0, len(u)))]
        chunks = [solid[k : k + _CHUNK] for k in range(0, len(solid), _CHUNK)]
        single = sorted(set(units) - set(solid))
        for chunk, ids in zip(chunks, self.whole([" ".join(c) for c in chunks]), strict=True):
            if ids is None:
                single += chunk
                continue
            end = np.cumsum([1 + len(u.encode()) for u in chunk])
            for kept, of_id, known in zip(ids, (self.a_length, self.b_length), (self.unit_a, self.unit_b), strict=True):
                at = np.concatenate([[0], 4 * np.searchsorted(np.cumsum(of_id[kept]), end) + 4]).tolist()
                raw = kept.tobytes()
                known.update(zip(chunk, map(raw.__getitem__, map(slice, at[:-1], at[1:])), strict=True))
        for unit, ids in zip(single, self.whole(single), strict=True):
            self._keep(unit, ids)

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids by both of every text after a space; None unless they join to its bytes.

        Neither tokenizer has a token that holds a blank after something
        solid, so texts are cut there and equal units are encoded once.  A text
        with a unit that does not come back is encoded whole.
        """
        cut = [_CUT.split(x) if self.cuts and _BLANK not in x else [""] for x in texts]
        new = {u for units in cut for u in units}
        if len(self.unit_a) + len(new) > _UNITS:
            self.unit_a.clear()
            self.unit_b.clear()
            self.bad = {""}
        new = [u for u in new if u and u not in self.unit_a]
        self.learn(new)
        a, b = self.unit_a.__getitem__, self.unit_b.__getitem__
        out = [
            (b"".join(map(a, units)), b"".join(map(b, units))) if self.bad.isdisjoint(units) else None for units in cut
        ]
        for unit in (u for u in new if len(u) > _LONGEST):
            del self.unit_a[unit], self.unit_b[unit]
        odd = [k for k, ids in enumerate(out) if ids is None and texts[k]]
        for k, ids in zip(odd, self.whole([texts[k] for k in odd]), strict=True):
            out[k] = tuple(x.tobytes() for x in ids) if ids else None
        return out


class Aligned:
    """Texts of a block whose tokens of both kinds join to the same bytes."""

    def __init__(self, both: Tokenizers, texts: list[bytes]) -> None:
        self.both, self.n = both, len(texts)
        ids = both.encode([x.decode() for x in texts])
        good = [k for k, x in enumerate(ids) if x is not None]
        self.good = np.array(good, np.int64)
        self.a, self.b = (np.frombuffer(b"".join(ids[k][side] for k in good), "<i4").astype(np.int64) for side in (0, 1))
        #: Texts follow each other; both kinds of tokens end where a text ends.
        self.a_matrix, self.b_matrix = Csr.spans(both.a_length[self.a]), Csr.spans(both.b_length[self.b])
        self.a_end, self.b_end = self.a_matrix.at[1:], self.b_matrix.at[1:]
        self.text_end = np.cumsum([1 + len(texts[k]) for k in good], dtype=np.int64)
        ends = np.zeros((2, self.a_matrix.width + 1), bool)
        ends[0, self.a_end], ends[1, self.b_end] = True, True
        both_end = ends[0] & ends[1]
        self.cut = np.flatnonzero(both_end)
        self.a_group, self.b_group = (np.cumsum(x) - x for x in (both_end[self.a_end], both_end[self.b_end]))

    def count(self, end: np.ndarray) -> np.ndarray:
        """How many of the ascending ends are in each text of the block."""
        out = np.zeros(self.n, np.int64)
        out[self.good] = np.diff(np.searchsorted(end, self.text_end, side="right"), prepend=0)
        return out

    def text_of(self, end: np.ndarray) -> np.ndarray:
        """The text in which each of the ascending ends is."""
        return np.repeat(np.arange(self.n), self.count(end))

    def overlaps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(A token, B token, common bytes)``."""
        return self.a_matrix.product(self.b_matrix.transposed())

    def together(self) -> tuple[np.ndarray, np.ndarray]:
        """Overlapping tokens that end at the same byte."""
        found = [(i, j) for i, j, _ in self.overlaps()]
        i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (self.a, self.b)
        same = self.a_end[i] == self.b_end[j]
        return i[same], j[same]

    def in_groups(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(A token, B token, 1)`` of one group."""
        groups = len(self.cut)
        a = Csr(np.arange(len(self.a) + 1), self.a_group, groups)
        b = Csr(np.arange(len(self.b) + 1), self.b_group, groups)
        return a.product(b.transposed())

    def written(self) -> list[bytes | None]:
        """``a1,a2|b1;a3|b2`` of each text: ids of both kinds, group by group."""
        out: list[bytes | None] = [None] * self.n
        if not len(self.a):
            return out
        size = self.both.ids
        a_first = np.diff(self.a_group, prepend=-1) > 0
        b_first = np.diff(self.b_group, prepend=-1) > 0
        a_last, b_start = np.flatnonzero(np.diff(self.a_group, append=len(self.cut))), np.flatnonzero(b_first)
        opens = np.zeros(len(self.a), bool)
        opens[np.concatenate([[0], np.searchsorted(self.a_end, self.text_end[:-1], side="right")])] = True
        sequence = np.empty(len(self.a) + len(self.b), np.int64)
        a_at = np.arange(len(self.a)) + b_start[self.a_group]
        b_at = np.arange(len(self.b)) + a_last[self.b_group] + 1
        sequence[a_at] = self.a + size * np.where(opens, 0, np.where(a_first, 1, 2))
        sequence[b_at] = self.b + size * np.where(b_first, 3, 2)
        parts = self.both.written[sequence].tolist()
        at = 0
        last = np.searchsorted(self.a_end, self.text_end, side="right") + np.searchsorted(self.b_end, self.text_end, side="right")
        for k, end in zip(self.good.tolist(), last.tolist(), strict=True):
            out[k] = b"".join(parts[at:end])
            at = end
        return out


def _texts(block: arrowtext.Block) -> list[bytes]:
    raw = block.data.tobytes()
    return [raw[block.at[k] : block.at[k + 1]] for k in range(len(block))]


def links(docs: DataFrame, a_path: str, b_path: str, kind: str = "overlap") -> DataFrame:
    """``doc_id, a_pos, a_id, b_pos, b_id, weight``: linked token occurrences of every text.

    ``kind``: ``overlap`` (weight: common bytes), ``group`` (tokens of one
    group, weight 1) or ``end`` (tokens that end together, weight 1).
    """
    if kind not in ("overlap", "group", "end"):
        raise ValueError(f"kind of link: {kind}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Tokenizers(a_path, b_path)
        for batch in batches:
            for block in arrowtext.blocks(batch.column(1)):
                found = Aligned(both, _texts(block))
                if kind == "end":
                    i, j = found.together()
                    slices = iter([(i, j, np.ones(len(i), np.int64))])
                else:
                    slices = found.overlaps() if kind == "overlap" else found.in_groups()
                a_before = np.cumsum(found.count(found.a_end)) - found.count(found.a_end)
                b_before = np.cumsum(found.count(found.b_end)) - found.count(found.b_end)
                for i, j, weight in slices:
                    text = found.text_of(found.a_end[i])
                    ids = batch.column(0).take(pa.array(block.first + text))
                    columns = (i - a_before[text], found.a[i], j - b_before[text], found.b[j], weight)
                    yield pa.RecordBatch.from_arrays(
                        [ids, *(pa.array(x.astype(np.int64)) for x in columns)],
                        names=["doc_id", "a_pos", "a_id", "b_pos", "b_id", "weight"],
                    )

    kind_of_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        run, f"doc_id {kind_of_id}, a_pos long, a_id long, b_pos long, b_id long, weight long"
    )


def _digests(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Counts and digest of every text, and its linked id pairs (``a << 32 | b``), each with how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Tokenizers(a_path, b_path)
        for batch in batches:
            for block in arrowtext.blocks(batch.column(1)):
                found = Aligned(both, _texts(block))
                i, j = found.together()
                text = found.text_of(found.a_end[i])
                pair = (found.a[i] << _B_BITS) | found.b[j]
                order = np.lexsort((pair, text))
                text, pair = text[order], pair[order]
                new = np.ones(len(pair), bool)
                new[1:] = (text[1:] != text[:-1]) | (pair[1:] != pair[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.concatenate([first, [len(pair)]]))
                at = pa.array(np.searchsorted(text[first], np.arange(len(block) + 1)).astype(np.int32))
                digest = ["" if x is None else hashlib.sha256(x).hexdigest() for x in found.written()]
                counts = [found.a_end, found.b_end, found.cut, found.a_end[i]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.first, len(block)),
                        *(pa.array(found.count(x).astype(np.int64)) for x in counts),
                        pa.array(digest),
                        pa.ListArray.from_arrays(at, pa.array(pair[first])),
                        pa.ListArray.from_arrays(at, pa.array(times.astype(np.int32))),
                    ],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )

    fields = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, fields + ", pairs array<long>, times array<int>"
    )


def _exploded(rows: DataFrame, pairs: str, times: str) -> DataFrame:
    one = F.explode(F.arrays_zip(F.col(pairs).alias("pair"), F.col(times).alias("times"))).alias("one")
    return rows.select("row", one).select("row", "one.pair", "one.times")


def pair_counts(rows: DataFrame) -> DataFrame:
    """``pair, n, best``: links of each id pair in all texts; whether that is the most of its B id."""
    counts = durable(_exploded(rows, "pairs", "times").groupBy("pair").agg(F.sum("times").alias("n")))
    b = F.col("pair").bitwiseAND(F.lit((1 << _B_BITS) - 1)).alias("b")
    most = counts.groupBy(b).agg(F.max("n").alias("most"))
    # At most one row for each id of the vocabulary.
    return durable(
        counts.join(F.broadcast(most), b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    )


def align(docs: DataFrame, a_path: str, b_path: str, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, one row per row of ``docs``.

    Links are token occurrences that end together.  A text that is null, empty
    or not given back byte by byte by both tokenizers has zeros and an empty
    digest.  Ids may be null or repeat; columns other than ``doc_id`` and
    ``text`` are not read.  No rows give no rows.  ``a_path`` (of the tokenizers
    library) and ``b_path`` (of sentencepiece) must be readable on executors.

    Counts of the ``hot_pairs`` most frequent id pairs are broadcast, so that
    no pair is hot in the join that looks up the others.
    """
    rows = durable(_digests(docs, a_path, b_path).withColumn("row", F.monotonically_increasing_id()))
    counts = pair_counts(rows)
    hot = counts.orderBy(F.desc("n"), "pair").limit(hot_pairs).toArrow().sort_by("pair")
    shared = docs.sparkSession.sparkContext.broadcast(
        (hot.column("pair").to_numpy(), hot.column("n").to_numpy(), hot.column("best").to_numpy(zero_copy_only=False))
    )
    plain = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "row"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            lists = batch.column("pairs")
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
            mine = lists.flatten().to_numpy()
            times = batch.column("times").flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), np.diff(at))
            place = np.minimum(np.searchsorted(pair, mine), max(len(pair) - 1, 0))
            known = pair[place] == mine if len(pair) else np.zeros(len(mine), bool)
            count, top = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(count, row[known], n[place[known]] * times[known])
            np.add.at(top, row[known], best[place[known]] * times[known])
            left = pa.array(np.searchsorted(row[~known], np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in plain), pa.array(top), pa.array(count),
                    pa.ListArray.from_arrays(left, pa.array(mine[~known])),
                    pa.ListArray.from_arrays(left, pa.array(times[~known].astype(np.int32))),
                ],
                names=[*plain, "n_best", "count_sum", "rest", "rest_times"],
            )

    fields = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, row long"
    found = rows.mapInArrow(look_up, fields + ", n_best long, count_sum long, rest array<long>, rest_times array<int>")
    found = durable(found)
    late = (
        _exploded(found.where(F.size("rest") > 0), "rest", "rest_times")
        .join(counts, "pair")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("late_best"),
            F.sum(F.col("n") * F.col("times")).alias("late_sum"),
        )
    )
    return found.join(late, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("late_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("late_sum", F.lit(0))).alias("count_sum"), "groups_sha256",
    )
