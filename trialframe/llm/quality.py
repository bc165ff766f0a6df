"""Quality rules with cross-document line frequency (operator 4).

Base rules look at one text.  Then every line with a word is normalised (A-Z
lower-cased, white space collapsed) and hashed, and each host's documents with
that line are counted; documents of equal words count once, so that copies are
left to deduplication.  A line of more than ``limit`` documents of a host is
removed from all of them but the first (smallest doc_id), and a document that
keeps less than ``MIN_KEPT`` of its words is depleted and rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.llm import arrowtext
from trialframe.session import durable

#: A line may be in this many documents of a host, or in this share of them if that is more.
MIN_DOCUMENTS = 20
SHARE = 0.01
#: A document must keep this share of its words.
MIN_KEPT = 0.3

MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0xA0761D6478BD642F)


class _Lines:
    """The lines with a word of a block: text, hash and number of words of each."""

    def __init__(self, block: arrowtext.Block, words: arrowtext.Words) -> None:
        breaks = np.flatnonzero(block.data == 10)
        line = np.searchsorted(breaks, words.start) + words.text
        # A line's number grows with each break and each new text.
        self.line, first, self.words = np.unique(line, return_index=True, return_counts=True)
        self.text = words.text[first]
        place = np.arange(len(words.hash)) - np.repeat(first, self.words)
        spread = arrowtext.mix(words.hash + place.astype(np.uint64) * _STEP)
        self.hash = arrowtext.mix(np.add.reduceat(spread, first)) if len(first) else spread
        self.breaks = breaks


def _lower(block: arrowtext.Block) -> arrowtext.Block:
    return arrowtext.Block(block.first, _LOWER[block.data], block.at)


def _repeated_words(words: arrowtext.Words, n: int) -> np.ndarray:
    """Words in 3-word windows found twice or more in their text, by text."""
    h = words.hash
    if len(h) < 3:
        return np.zeros(n, np.int64)
    key = arrowtext.mix(h[:-2] * np.uint64(3) + arrowtext.mix(h[1:-1] + _STEP) + arrowtext.mix(h[2:] ^ _STEP))
    key = arrowtext.mix(key + words.text[:-2].astype(np.uint64) * _STEP)
    place = np.flatnonzero(words.text[:-2] == words.text[2:])
    key = key[place]
    order = np.sort(key)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    cover = np.zeros(len(h), bool)
    if len(twice):
        at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
        hit = place[twice[at] == key]
        for k in range(3):
            cover[hit + k] = True
    return np.bincount(words.text[cover], minlength=n)


def _repeated_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in data:
        return 0
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def measures(docs: DataFrame) -> DataFrame:
    """Measures of each text and its distinct normalised lines with their words.

    ``doc_id, host, content, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, lines array<struct<line, words>>``; ``content`` hashes the
    text's words.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in arrowtext.blocks(batch.column(2)):
                n = len(block)
                words = arrowtext.Words(block)
                low = arrowtext.Words(_lower(block))
                lines = _Lines(block, low)
                text_of = np.repeat(np.arange(n), np.diff(block.at))
                solid = ((block.data & 0xC0) != 0x80) & ~arrowtext._SPACE[block.data]
                place = np.arange(len(words.hash), dtype=np.uint64)
                place -= words.span[words.text].astype(np.uint64)
                content = arrowtext.per_text(
                    np.add, arrowtext.mix(words.hash + place * _STEP), words.text, n, 0
                )
                raw = block.data.tobytes()
                doubled = [_repeated_lines(raw[block.at[k] : block.at[k + 1]]) for k in range(n)]
                # Distinct lines of each text, with the words of all their occurrences.
                order = np.lexsort((lines.hash, lines.text))
                text, line, size = lines.text[order], lines.hash[order], lines.words[order]
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (line[1:] != line[:-1])
                at = np.flatnonzero(new)
                total = np.add.reduceat(size, at) if len(at) else size
                offsets = np.searchsorted(text[at], np.arange(n + 1)).astype(np.int32)
                pairs = pa.StructArray.from_arrays(
                    [pa.array(line[at].view(np.int64)), pa.array(total.astype(np.int64))], ["line", "words"]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.first, n),
                        batch.column(1).slice(block.first, n),
                        pa.array(content.view(np.int64)),
                        pa.array(np.diff(words.span).astype(np.int64)),
                        pa.array(np.bincount(text_of[solid], minlength=n).astype(np.int64)),
                        pa.array(np.bincount(text_of[_SYMBOL[block.data]], minlength=n).astype(np.int64)),
                        pa.array(doubled, pa.int64()),
                        pa.array(_repeated_words(words, n).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(offsets), pairs),
                    ],
                    names=[
                        "doc_id", "host", "content", "n_words", "word_chars", "n_symbols",
                        "n_dup_lines", "n_repeat_words", "lines",
                    ],
                )

    return docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")
    ).mapInArrow(
        measure,
        "doc_id long, host string, content long, n_words long, word_chars long, n_symbols long, "
        "n_dup_lines long, n_repeat_words long, lines array<struct<line: long, words: long>>",
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rejected(
    docs: DataFrame, min_documents: int = MIN_DOCUMENTS, share: float = SHARE, min_kept: float = MIN_KEPT
) -> DataFrame:
    """Measures and verdict of every row, with the hashes of the lines to remove.

    ``docs`` has ``doc_id``, ``text`` and ``source`` (the host; null is a host
    of its own).  A null text is empty and fails the base rules.  Rows that
    share doc_id and words count once and get equal rows.  A row with a null
    doc_id loses no line.  No rows give no rows.
    """
    base = durable(measures(docs))
    held = base.select("doc_id", F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("bare"),
                       "content", F.explode("lines").alias("x")).select(
        "doc_id", "host", "bare", "content", "x.line", "x.words"
    )
    sizes = base.groupBy(F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("bare")).agg(
        F.count_distinct("content").alias("documents")
    )
    frequent = durable(
        held.groupBy("host", "bare", "line", "content")
        .agg(F.min("doc_id").alias("doc_id"))
        .groupBy("host", "bare", "line")
        .agg(F.count("*").alias("documents_with"), F.min("doc_id").alias("first_doc"))
        .where(F.col("documents_with") > min_documents)
        .join(sizes, ["host", "bare"])
        .where(F.col("documents_with") > share * F.col("documents"))
        .select("host", "bare", "line", "first_doc")
    )
    lost = (
        held.join(frequent, ["host", "bare", "line"])
        .where("doc_id <> first_doc")
        .groupBy("doc_id", "content", "line")
        .agg(F.max("words").alias("words"))
        .groupBy("doc_id", "content")
        .agg(F.sum("words").alias("n_words_removed"), F.collect_list("line").alias("removed"))
    )
    left = F.col("n_words") - F.col("n_words_removed")
    return (
        base.drop("lines", "host")
        .join(lost, ["doc_id", "content"], "left")
        .withColumn("n_words_removed", F.coalesce("n_words_removed", F.lit(0)))
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & (left >= min_kept * F.col("n_words")))
    )


def without_lines(docs: DataFrame, removed: str) -> DataFrame:
    """``docs`` whose ``text`` lost the lines with the hashes in array column ``removed``.

    A removed line goes with its line break.  ``n_chars``, where there, is set anew.
    """
    schema = docs.select(*[c for c in docs.columns if c != removed]).schema
    place, mark = docs.columns.index("text"), docs.columns.index(removed)

    def cut(raw: bytes, drop: set[int]) -> str:
        block = arrowtext.Block(0, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        lines = _Lines(block, arrowtext.Words(_lower(block)))
        gone = {int(k) for k, h in zip(lines.line, lines.hash.view(np.int64), strict=True) if int(h) in drop}
        return b"\n".join(x for k, x in enumerate(raw.split(b"\n")) if k not in gone).decode()

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drops = batch.column(mark).to_pylist()
            columns = [batch.column(k) for k in range(batch.num_columns) if k != mark]
            own = place - (mark < place)
            if any(drops):
                texts = batch.column(place).to_pylist()
                columns[own] = pa.array(
                    [cut(t.encode(), set(d)) if d and t else t for t, d in zip(texts, drops, strict=True)],
                    batch.column(place).type,
                )
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    out = docs.mapInArrow(rewrite, schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType))
    return out


def clean(docs: DataFrame, **limits: float) -> DataFrame:
    """``docs`` without rejected rows and frequent lines; columns as they were.

    A row with a null doc_id stays, as nothing is known of it.
    """
    verdict = (
        rejected(docs, **limits)
        .where("doc_id is not null")
        .groupBy(F.col("doc_id").alias("__id"))
        .agg(F.max("kept").alias("__kept"), F.array_distinct(F.flatten(F.collect_list("removed"))).alias("__removed"))
    )
    kept = docs.join(verdict, docs["doc_id"].cast("long") == verdict["__id"], "left").where(
        F.coalesce("__kept", F.lit(True))
    )
    return without_lines(kept.select(*[docs[c] for c in docs.columns], "__removed"), "__removed").select(docs.columns)
